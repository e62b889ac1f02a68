"""Ignore rules of many repositories as a table.

Of a rule that is said more than once in a directory only the last can decide, so that one
is kept. Rules meet distinct paths by equality on a literal key of each rule, laid out as
rows: the whole glob if it has no wildcard, else a piece of its literal end or beginning, of
a length that is a power of two, or, where more than `CROWD` rules of the repository share
that, the piece of the glob that the fewest share, wherever it stands. A path carries one key
for each shape (kind and length) that its repository's rules have, or its distinct pieces of
that length for those that may stand anywhere, so that it costs a number of rows that its
length bounds whatever the number of rules, and only candidates are tried with the regular
expression. The last match by order decides. Rules without a literal of two characters
(`*`, `a*`, `?b?`) can crowd their keys and are tried with every path that has them.

Two readings of a rule:

* plain, as `functions.ignore` folds it: a glob is matched with the whole path and with the
  base name, rules for directories (`foo/`) never match a file, `**` keeps to one element;
* strict, as version control reads ignore files: rules of a file below the root hold
  in its directory, a glob with a slash is anchored there, `**` spans directories, `[..]`
  is a class, deeper files override, and what lies in an excluded directory is excluded.
  (Classes by name, as `[[:alpha:]]`, are not known.)

A glob with a backslash ahead of a letter or digit, or at its end, is no plain rule.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from creditledger.functions.fixed_values import WHITE_SPACE
from creditledger.functions.paths import base_name
from creditledger.operators.joins import null_safe_join

#: Lengths of literal keys.
KEY_LENGTHS = (32, 16, 8, 4, 2, 1)
#: Lengths of literal keys that may stand anywhere in a path.
INSIDE_LENGTHS = (8, 4, 2)
#: So many rules of a repository may share a key before another is looked for.
CROWD = 32
_SPECIAL = r"[\\.\[\](){}^$+|*?]"


def rule_lines(files: DataFrame, strict: bool = False) -> DataFrame:
    """repo, dir, file, line, glob, negate, dir_only from ignore files (repo, dir, text and,
    where several of them stand for one, their number `file`)."""
    number = F.col("file") if "file" in files.columns else F.lit(0).cast("long")

    def trimmed(line: Column) -> Column:
        if strict:
            # Blanks at the end go, unless a backslash holds the first of them.
            return F.regexp_replace(F.regexp_replace(line, r"\r$", ""), r"(?<!\\) +$", "")
        return F.trim(line, F.lit(WHITE_SPACE))

    # Trimmed ahead of the explode, so that each use of a line does not trim it anew.
    said = F.transform(F.split("text", "\n", -1), trimmed)
    lines = files.select("repo", "dir", number.alias("file"), F.posexplode_outer(said).alias("line", "said"))
    lines = lines.filter((F.col("said") != "") & ~F.col("said").startswith("#"))
    negate = F.col("said").startswith("!")
    glob = F.when(negate, F.substring("said", 2, 2**31 - 1)).otherwise(F.col("said"))
    dir_only = F.col("glob").endswith("/")
    bare = F.regexp_replace("glob", "/$", "")
    rules = lines.select("repo", "dir", "file", "line", glob.alias("glob"), negate.alias("negate")).select(
        "repo", "dir", "file", "line", bare.alias("glob"), "negate", dir_only.alias("dir_only")
    )
    return rules.filter(F.col("glob") != "") if strict else rules.filter(~F.col("glob").rlike(r"\\(?:[A-Za-z0-9]|$)"))


def _quoted(text: Column) -> Column:
    return F.regexp_replace(text, _SPECIAL, r"\\$0")


def _plain_regex(glob: Column) -> Column:
    def piece(token: Column) -> Column:
        return (
            F.when(token == "**", ".[^/]*")
            .when(token == "*", "[^/]*")
            .when(token == "?", ".")
            .otherwise(F.regexp_replace(token, r"[.\[\](){}^$+|]", r"\\$0"))
        )

    tokens = F.regexp_extract_all(glob, F.lit(r"(?s)(\*\*|.)"), F.lit(1))
    return F.concat(F.lit("(?d)^"), F.array_join(F.transform(tokens, piece), ""), F.lit(r"\z"))


_STRICT_TOKEN = r"(?s)(\\.|^(?:\*\*/)+|/\*\*\z|/(?:\*\*/)+|\*+|\[[!^]?\]?(?:\\.|[^\]\\])*\]|.)"


def _strict_regex(directory: Column, glob: Column, anchored: Column) -> Column:
    def class_of(token: Column) -> Column:
        body = token.substr(F.lit(2), F.length(token) - 2)
        negated = body.rlike("^[!^]")
        body = F.regexp_replace(body, "^[!^]", "")
        body = F.regexp_replace(F.regexp_replace(body, r"^\]", r"\\]"), r"(?<!\\)[\[&^]", r"\\$0")
        return F.concat(F.lit("(?!/)["), F.when(negated, "^").otherwise(""), body, F.lit("]"))

    def piece(token: Column) -> Column:
        return (
            F.when(token.startswith("\\") & (F.length(token) > 1), _quoted(F.substring(token, 2, 2)))
            .when(token.startswith("**/"), "(?:.*/)?")
            .when(token == "/**", "/.+")
            .when(token.startswith("/**/"), "/(?:.*/)?")
            .when(token.startswith("*"), "[^/]*")
            .when(token == "?", "[^/]")
            .when(token.startswith("[") & (F.length(token) > 2), class_of(token))
            .otherwise(_quoted(token))
        )

    tokens = F.regexp_extract_all(glob, F.lit(_STRICT_TOKEN), F.lit(1))
    above = F.when(directory == "", "").otherwise(F.concat(_quoted(directory), F.lit("/")))
    free = F.when(anchored, "").otherwise("(?:.*/)?")
    return F.concat(F.lit("(?s)^"), above, free, F.array_join(F.transform(tokens, piece), ""), F.lit(r"\z"))


def _piece_length(text: Column, lengths: tuple[int, ...] = KEY_LENGTHS) -> Column:
    length = F.lit(0)
    for n in reversed(lengths):
        length = F.when(F.length(text) >= n, n).otherwise(length)
    return length


def _key(kind: str, size: Column, literal: Column) -> Column:
    return F.struct(F.lit(kind).alias("kind"), size.alias("size"), literal.alias("literal"))


def _inside_keys(run: Column) -> Column:
    """Keys that together cover a literal run of two characters or more."""
    size = _piece_length(run, INSIDE_LENGTHS)
    starts = F.array_union(F.sequence(F.lit(1), F.length(run) - size + 1, size), F.array(F.length(run) - size + 1))
    return F.transform(starts, lambda at: _key("inside", size, run.substr(at, size)))


def _last_said(lines: DataFrame) -> DataFrame:
    """`lines` without those that a later line of the same directory says again, for or against."""
    place = F.struct("file", "line")
    return (
        lines.groupBy("repo", "dir", "glob", "dir_only")
        .agg(F.max(place).alias("place"), F.max_by("negate", place).alias("negate"))
        .select("repo", "dir", "glob", "dir_only", "place.*", "negate")
    )


def _with_key(rules: DataFrame) -> DataFrame:
    """Each of the distinct `rules` with one of its possible `keys`: the first of them that
    no more than `CROWD` rules of the repository could have, else the rarest."""
    rule = [c for c in rules.columns if c != "keys"]
    # With the inner form Spark would look for empty keys in every line, ahead of `_last_said`.
    options = rules.select(*rule, F.posexplode_outer("keys").alias("choice", "key")).select(*rule, "choice", "key.*")
    place = ["repo", "kind", "size", "literal"]
    shared = options.groupBy(*place).agg(F.count(F.lit(1)).alias("shared"))
    rank = F.struct(F.greatest("shared", F.lit(CROWD)), "choice")
    return null_safe_join(options, shared, place).groupBy(*rule).agg(F.min_by(F.struct(*place[1:]), rank).alias("key")).select(*rule, "key.*")


def compile_rules(lines: DataFrame, strict: bool = False) -> DataFrame:
    """repo, depth, file, line, negate, dir_only, on_base, regex and the key (kind, size,
    literal), for the last of the lines that say the same."""
    glob = F.col("glob")
    anchored = glob.contains("/")
    bare = F.regexp_replace(glob, "^/", "") if strict else glob
    rules = _last_said(lines).select("*", bare.alias("bare"))
    bare = F.col("bare")
    if strict:
        above = F.when(F.col("dir") == "", "").otherwise(F.concat("dir", F.lit("/")))
        wild, escape = r"[*?\[\\]", r"[\[\\]"
        start = F.regexp_extract(bare, r"^([^*?\[\\]*)", 1)
        head = F.when(anchored, F.concat(above, start)).otherwise(above)
        tail = F.regexp_extract(bare, r"([^*?\[\]\\/]*)$", 1)
        literal_glob = F.when(anchored, F.concat(above, bare)).otherwise(bare)
        runs = F.concat(F.array(above), F.split(bare, r"[*?/]", -1))
    else:
        wild, escape = r"[*?\\]", r"\\"
        head, tail = F.regexp_extract(bare, r"^([^*?\\]*)", 1), F.regexp_extract(bare, r"([^*?\\]*)$", 1)
        literal_glob = bare
        runs = F.split(bare, r"[*?]", -1)
    rules = rules.select("*", head.alias("head"), tail.alias("tail"), literal_glob.alias("literal_glob"), runs.alias("runs"))
    head, tail = _piece_length(F.col("head")), _piece_length(F.col("tail"))
    end, begin = _key("end", tail, F.right("tail", tail)), _key("begin", head, F.left("head", head))
    ends = F.filter(F.when(tail >= head, F.array(end, begin)).otherwise(F.array(begin, end)), lambda key: key["size"] > 0)
    # What stands between wildcards is literal if nothing is escaped or a class.
    literal_runs = F.filter("runs", lambda run: (F.length(run) >= min(INSIDE_LENGTHS)) & ~bare.rlike(escape))
    inside = F.flatten(F.transform(literal_runs, _inside_keys))
    keys = (
        F.when(~bare.rlike(wild), F.array(_key("whole", F.lit(0), F.col("literal_glob"))))
        .when(F.size(ends) > 0, F.concat(ends, inside))
        .otherwise(F.concat(F.array(_key("any", F.lit(0), F.lit(""))), inside))
    )
    rules = _with_key(rules.select("repo", "dir", "glob", "dir_only", "file", "line", "negate", "bare", F.array_distinct(keys).alias("keys")))
    depth = F.when(F.col("dir") == "", 0).otherwise(F.size(F.split("dir", "/")))
    regex = _strict_regex(F.col("dir"), bare, anchored) if strict else _plain_regex(glob)
    return rules.select(
        "repo", depth.alias("depth"), "file", "line", "negate", "dir_only", F.lit(not strict).alias("on_base"), regex.alias("regex"),
        "kind", "size", "literal",
    )


def verdicts(entities: DataFrame, rules: DataFrame) -> DataFrame:
    """repo, path, is_dir, ignored of those entities (repo, path, is_dir) that a rule
    matches, by the last of its matches: deeper files first, then by order."""
    shapes = rules.groupBy("repo").agg(F.collect_set(F.struct("kind", "size")).alias("shapes"))
    path, base = F.col("path"), base_name(F.col("path"))

    def keys(shape: Column) -> Column:
        kind, size = shape["kind"], shape["size"]
        texts = (
            F.when(kind == "whole", F.array(path, base))
            .when(kind == "end", F.array(F.right(path, size)))
            .when(kind == "begin", F.array(F.left(path, size), F.left(base, size)))
            .when(kind == "inside", F.transform(F.sequence(F.lit(1), F.greatest(F.length(path) - size + 1, F.lit(1))), lambda at: path.substr(at, size)))
            .otherwise(F.array(F.lit("")))
        )
        return F.transform(F.array_distinct(texts), lambda text: F.struct(kind.alias("kind"), size.alias("size"), text.alias("literal")))

    keyed = (
        null_safe_join(entities.select("repo", "path", "is_dir"), shapes, ["repo"])
        .select("repo", "path", "is_dir", F.explode_outer(F.flatten(F.transform("shapes", keys))).alias("key"))
        .select("repo", "path", "is_dir", "key.*")
    )
    tried = null_safe_join(keyed, rules, ["repo", "kind", "size", "literal"])
    hit = F.expr("path RLIKE regex OR (on_base AND substring_index(path, '/', -1) RLIKE regex)")
    order = F.struct("depth", "file", "line")
    return (
        tried.filter((~F.col("dir_only") | F.col("is_dir")) & hit)
        .groupBy("repo", "path", "is_dir")
        .agg((~F.max_by("negate", order)).alias("ignored"))
    )


def ignored_paths(files: DataFrame, rules: DataFrame) -> DataFrame:
    """repo, path: files (repo, path) whose last matching plain rule ignores them."""
    entities = files.select("repo", "path", F.lit(False).alias("is_dir")).distinct()
    return verdicts(entities, rules).filter("ignored").select("repo", "path")


def ignored_paths_strict(files: DataFrame, rules: DataFrame) -> DataFrame:
    """repo, path: files that version control leaves out. Directories are judged once
    each, then inherit what is above them; a file looks at itself and its directory."""
    parts = F.split("path", "/")
    parent = F.array_join(F.slice(parts, 1, F.size(parts) - 1), "/")
    files = files.select("repo", "path", parent.alias("parent")).distinct()
    directories = files.filter("parent <> ''").select("repo", F.col("parent").alias("path")).distinct()
    steps = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(steps)), lambda n: F.array_join(F.slice(steps, 1, n), "/"))
    lineage = directories.select("repo", F.col("path").alias("inside"), F.explode(above).alias("path"))
    every = lineage.select("repo", "path").distinct()
    judged = verdicts(
        every.select("repo", "path", F.lit(True).alias("is_dir")).union(files.select("repo", "path", F.lit(False))), rules
    ).filter("ignored")
    closed = null_safe_join(lineage, judged.filter("is_dir").select("repo", "path"), ["repo", "path"]).select(
        "repo", F.col("inside").alias("parent")
    ).distinct()
    inherited = null_safe_join(files, closed, ["repo", "parent"]).select("repo", "path")
    return inherited.union(judged.filter("NOT is_dir").select("repo", "path")).distinct()


def without_ignored(files: DataFrame, rules: DataFrame, strict: bool = False) -> DataFrame:
    """`files` (repo, path and others) without those that `rules`, compiled in the same
    reading, leave out."""
    gone = (ignored_paths_strict if strict else ignored_paths)(files, rules)
    gone = gone.toDF("_repo", "_path")
    same = F.col("repo").eqNullSafe(F.col("_repo")) & (F.col("path") == F.col("_path"))
    return files.join(gone, same, "left_anti")
