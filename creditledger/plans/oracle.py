"""DuckDB SQL for the registered queries, written independently of the Spark plans:
plain windows, full outer joins, regular expressions and CASE."""

from __future__ import annotations

from creditledger.functions import fixed_values as fv
from creditledger.plans import driver_views as views


def _quoted(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def _regex_any(values) -> str:
    return "|".join(v.replace(".", r"\.") for v in values)


def _with(ctes: dict[str, str], body: str) -> str:
    return "WITH " + ",\n".join(f"{name} AS ({sql})" for name, sql in ctes.items()) + "\n" + body


# --- views --------------------------------------------------------------------

AFTER = f"TIMESTAMP '{views.WINDOW_AFTER}'"
UNTIL = f"TIMESTAMP '{views.WINDOW_UNTIL}'"

TOUCHES = """
SELECT concat(event_type, ':', json_extract_string(props, '$.k')) AS k, event_type AS type,
       user_id % 25 AS actor, ts, event_id FROM events"""

PATHS = f"""
SELECT *, concat(list_extract([{_quoted(views.DIRECTORIES)}], CAST(doc_id % 16 + 1 AS INT)),
       list_extract([{_quoted(views.BASE_NAMES)}], CAST((doc_id // 16) % 23 + 1 AS INT))) AS path
FROM documents"""

RENAMED_PATH = f"""concat(list_extract([{_quoted(views.DIRECTORIES)}], CAST((doc_id + 1) % 16 + 1 AS INT)),
       list_extract([{_quoted(views.BASE_NAMES)}], CAST(((doc_id + 1) // 16) % 23 + 1 AS INT)))"""

AUTHOR_CASE = """CASE (doc_id + n*3) % 6 WHEN 0 THEN 'alice' WHEN 1 THEN 'Alice Anno <alice@x.org>'
    WHEN 2 THEN 'Bob <bob@x.org>' WHEN 3 THEN 'Robert <bob2@x.org>'
    WHEN 4 THEN 'carol' ELSE 'unknown' END"""

PLAIN_LINES = """
SELECT doc_id, path, generate_subscripts(s, 1) - 1 AS n, unnest(s) AS l
FROM (SELECT doc_id, path, string_split(text, chr(10)) AS s FROM v_paths)"""

LINES = f"""
SELECT doc_id, path, n + 1 AS line_no,
  CASE (doc_id*31 + n*7) % 13 WHEN 0 THEN concat('/* ', l) WHEN 1 THEN concat(l, ' */ x')
    WHEN 2 THEN concat('// ', l) WHEN 3 THEN concat(l, ' */ b /*') WHEN 4 THEN ''
    WHEN 5 THEN concat('a /* b */ ', l) ELSE l END AS content,
  {AUTHOR_CASE} AS raw_author,
  (doc_id*7 + n*13) % 100 AS touch_seq
FROM v_plain"""

HUNKS = """
SELECT doc_id, path, doc_id % 40 AS commit_id, 1 + doc_id * 7 % len(string_split(text, chr(10))) AS start, 1 + doc_id * 11 % len(string_split(text, chr(10))) AS cnt,
  CASE doc_id % 3 WHEN 0 THEN 'alice' WHEN 1 THEN 'Bob <bob@x.org>' ELSE 'dave' END AS deleting_author
FROM v_paths"""

ALIASES = (
    "SELECT * FROM (VALUES "
    + ", ".join(f"('{k}', '{a}', '{c}', {o})" for k, a, c, o in views.ALIAS_ROWS)
    + ") v(kind, alias_lower, canonical, ord)"
)

FILE_VIEWS = {"v_paths": PATHS}
LINE_VIEWS = {**FILE_VIEWS, "v_plain": PLAIN_LINES, "v_lines": LINES}
ALL_VIEWS = {**LINE_VIEWS, "v_hunks": HUNKS, "v_aliases": ALIASES}

# --- paths --------------------------------------------------------------------

BASE = "regexp_extract(path, '([^/]*)$', 1)"
EXT = r"lower(regexp_extract(path, '(\.[^./]*)$', 1))"
LANGUAGE = (
    f"CASE {EXT} "
    + " ".join(f"WHEN '{ext}' THEN '{lang}'" for ext, lang in fv.LANGUAGE_BY_EXTENSION.items())
    + " ELSE 'other' END"
)
IS_CODE = (
    f"({EXT} IN ({_quoted(fv.LANGUAGE_BY_EXTENSION)}) OR lower({BASE}) = '.ansible-lint' OR "
    rf"regexp_matches(lower({BASE}), '^(dockerfile|docker-compose|podman-compose)|\.dockerfile$'))"
)
IS_SKIPPED = (
    rf"regexp_matches(path, '(^|/)({_regex_any(fv.SKIPPED_DIRECTORIES)}|[^/]*\.egg-info)/')"
)
IS_BUILD = (
    f"({EXT} IN ({_quoted(fv.QUADLET_EXTENSIONS + fv.BUILD_EXTENSIONS)}) OR "
    f"lower({BASE}) IN ({_quoted(fv.BUILD_BASENAMES + fv.COMPOSE_BASENAMES)}) OR "
    rf"regexp_matches(lower({BASE}), '^tsconfig.*\.json$|^(dockerfile|docker-compose|podman-compose)|\.dockerfile$') "
    r"OR regexp_matches(path, '(^|/)\.github/'))"
)
IS_TEST_NAME = (
    rf"(regexp_matches(lower({BASE}), '_test\.(go|py)$|^test_.*\.py$|\.(test|spec)\.([jt]sx?|[mc]js)$') "
    rf"OR {BASE} = 'conftest.py' OR regexp_matches({BASE}, 'Tests?\.(java|kt|scala)$'))"
)
IS_TEST = f"({IS_TEST_NAME} OR list_has_any(string_split(lower(path), '/'), [{_quoted(fv.TEST_SEGMENTS)}]))"
IS_RESOURCE = f"list_has_any(string_split(lower(path), '/'), [{_quoted(fv.RESOURCE_SEGMENTS)}])"
TYPE = f"""CASE WHEN {IS_BUILD} THEN 'build'
  WHEN {EXT} IN ('.sh', '.bash', '.zsh') THEN 'scripts'
  WHEN {EXT} IN ('.md', '.txt', '.rst', '.adoc') THEN 'documentation'
  WHEN {LANGUAGE} = 'other' THEN 'other'
  WHEN {IS_TEST} AND {IS_RESOURCE} THEN 'test_resources'
  WHEN {IS_TEST} THEN 'test_code' WHEN {IS_RESOURCE} THEN 'main_resources' ELSE 'main_code' END"""
TYPE_LANGUAGE = f"""CASE WHEN {IS_BUILD} THEN {LANGUAGE}
  WHEN {EXT} IN ('.sh', '.bash', '.zsh') THEN 'shell'
  WHEN {EXT} IN ('.md', '.txt', '.rst', '.adoc') THEN 'text' ELSE {LANGUAGE} END"""

PATH_TYPES = f"SELECT doc_id, path, {TYPE} AS type, {TYPE_LANGUAGE} AS language, {IS_CODE} AS is_code FROM v_paths"


def _path_query(**columns: str) -> str:
    extra = ", ".join(f"{sql} AS {name}" for name, sql in columns.items())
    return _with(FILE_VIEWS, f"SELECT doc_id, path, {extra} FROM v_paths")


def _ignored() -> str:
    whens = [
        f"WHEN regexp_matches(path, '{r.regex}') OR regexp_matches({BASE}, '{r.regex}') "
        f"THEN {'false' if r.negate else 'true'}"
        for r in reversed(views.IGNORE_RULES)
    ]
    return f"(CASE {' '.join(whens)} ELSE false END)"


# --- lines --------------------------------------------------------------------

_WS = " || ".join(f"chr({ord(c)})" for c in fv.WHITE_SPACE)


def _automaton(source: str, keys: str) -> dict[str, str]:
    """CTEs ending in `flagged`: the source with `filled` and `code` (0/1)."""
    return {
        "ws": f"SELECT {_WS} AS ws",
        "trimmed": f"SELECT s.*, trim(content, ws) AS t, ws FROM {source} s, ws",
        "found": "SELECT *, instr(t, '/*') AS o, instr(t, '*/') AS c,"
        r" regexp_matches(t, '^(//|#|--|\*)') AS lc FROM trimmed",
        "closing": "SELECT *, CASE WHEN o > 0 THEN instr(substr(t, o + 2), '*/') ELSE 0 END AS c2 FROM found",
        "parts": "SELECT *, CASE WHEN o > 0 THEN trim(substr(t, 1, o - 1), ws) ELSE '' END AS before,"
        " CASE WHEN c2 > 0 THEN trim(substr(t, o + 2 + c2 + 1), ws) ELSE '' END AS after0,"
        " CASE WHEN c > 0 THEN trim(substr(t, c + 2), ws) ELSE '' END AS after1 FROM closing",
        "moves": r"""SELECT *,
            CASE WHEN t <> '' AND NOT lc AND o > 0 AND c2 = 0 THEN 1 ELSE 0 END AS n0,
            CASE WHEN t <> '' AND c > 0 THEN 0 ELSE 1 END AS n1,
            CASE WHEN t = '' OR lc THEN 0 WHEN o = 0 THEN 1 WHEN before <> '' THEN 1
                 WHEN c2 > 0 AND after0 <> '' AND NOT regexp_matches(after0, '^(//|#|--|\*)') THEN 1
                 ELSE 0 END AS k0,
            CASE WHEN t <> '' AND c > 0 AND after1 <> ''
                  AND NOT regexp_matches(after1, '^(//|#|--|\*)') THEN 1 ELSE 0 END AS k1
            FROM parts""",
        "kinds": "SELECT *, CASE WHEN n0 = n1 THEN n0 END AS cv,"
        " CASE WHEN n0 = 1 AND n1 = 0 THEN 1 ELSE 0 END AS fl FROM moves",
        "flips": f"SELECT *, sum(fl) OVER (PARTITION BY {keys} ORDER BY line_no) AS cf FROM kinds",
        "marks": f"""SELECT *, last_value(CASE WHEN cv IS NOT NULL THEN cv + cf END IGNORE NULLS)
            OVER (PARTITION BY {keys} ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS m FROM flips""",
        "states": "SELECT *, CAST((coalesce(m, 0) + cf) % 2 AS INT) AS after_bit FROM marks",
        "befores": f"SELECT *, coalesce(lag(after_bit) OVER (PARTITION BY {keys} ORDER BY line_no), 0)"
        " AS before_bit FROM states",
        "flagged": "SELECT * EXCLUDE (before), CASE WHEN t <> '' THEN 1 ELSE 0 END AS filled,"
        " CASE WHEN before_bit = 1 THEN k1 ELSE k0 END AS code FROM befores",
    }


COUNTABLE = "CASE WHEN type = 'documentation' THEN filled ELSE code END"

# --- people -------------------------------------------------------------------


def _resolved(source: str, actor: str, into: str) -> str:
    """The source with `into`: actor by full name, address, short name, or itself."""
    names = "(SELECT alias_lower, arg_max(canonical, ord) AS canonical FROM v_aliases WHERE kind = '{}' GROUP BY 1)"
    return f"""SELECT s.*, CASE WHEN s.{actor} IN ('', 'unknown') THEN s.{actor}
        ELSE coalesce(a.canonical, b.canonical, c.canonical, s.{actor}) END AS {into}
      FROM {source} s
      LEFT JOIN {names.format('name')} a ON a.alias_lower = lower(s.{actor})
      LEFT JOIN {names.format('email')} b ON b.alias_lower = lower(nullif(regexp_extract(s.{actor}, '<([^>]+)>', 1), ''))
      LEFT JOIN {names.format('name')} c ON s.{actor} LIKE '%<%'
            AND c.alias_lower = lower(trim(split_part(s.{actor}, '<', 1)))"""


# --- report -------------------------------------------------------------------


def _share(part: str, whole: str) -> str:
    return f"coalesce(CAST({part} AS DOUBLE) * CAST(100 AS DOUBLE) / CAST(nullif({whole}, 0) AS DOUBLE), CAST(0 AS DOUBLE))"


ROLLUP = """
SELECT type, author, CAST(grouping(type) * 2 + grouping(author) AS INTEGER) AS level,
       CAST(sum(lines) AS BIGINT) AS lines, CAST(sum(deleted) AS BIGINT) AS deleted,
       CAST(sum(lines) - sum(deleted) AS BIGINT) AS net
FROM base GROUP BY GROUPING SETS ((type, author), (type), (author), ())"""

SECTIONS = f"""
SELECT 'by_author_and_type' AS section, p.type, p.author, p.lines, {_share('p.lines', 't.lines')} AS share, p.deleted, p.net
  FROM (SELECT * FROM rolled WHERE level = 0) p JOIN (SELECT * FROM rolled WHERE level = 1) t ON p.type = t.type
UNION ALL SELECT 'by_author_and_type_total', type, NULL, lines, CAST(100 AS DOUBLE), deleted, net FROM rolled WHERE level = 1
UNION ALL SELECT 'by_type', type, NULL, lines, {_share('lines', '(SELECT lines FROM rolled WHERE level = 3)')}, deleted, net
  FROM rolled WHERE level = 1
UNION ALL SELECT 'by_author', NULL, author, lines, {_share('lines', '(SELECT lines FROM rolled WHERE level = 3)')}, deleted, net
  FROM rolled WHERE level = 2
UNION ALL SELECT 'total', NULL, NULL, lines, CAST(100 AS DOUBLE), deleted, net FROM rolled WHERE level = 3"""

PERCENT = "printf('%.2f%%', share)"


def _report(ctes: dict[str, str], body: str) -> str:
    """`ctes` must end in base(type, author, lines, deleted)."""
    return _with({**ctes, "rolled": ROLLUP, "sections": SECTIONS}, body)


EVENT_BASE = {
    "base": "SELECT event_type AS type, user_id % 25 AS author, count(*) AS lines, 0 AS deleted FROM events GROUP BY 1, 2"
}

# --- touches ------------------------------------------------------------------

LAST_TOUCH = f"""
SELECT k, ts, event_id, type, actor FROM (
  SELECT *, row_number() OVER (PARTITION BY k ORDER BY ts DESC, event_id DESC) AS rn
  FROM v_touches WHERE ts <= {UNTIL}) WHERE rn = 1 AND ts > {AFTER}"""

DISPLACEMENTS = f"""
SELECT k, ts, event_id, type, actor, prev AS displaced FROM (
  SELECT *, lag(actor) OVER (PARTITION BY k ORDER BY ts, event_id) AS prev FROM v_touches)
WHERE ts > {AFTER} AND ts <= {UNTIL} AND prev IS NOT NULL AND prev <> actor"""

NET_BASE = {
    "v_touches": TOUCHES,
    "last_touches": LAST_TOUCH,
    "displaced": DISPLACEMENTS,
    "facts": "SELECT type, actor AS author, count(*) AS lines FROM last_touches GROUP BY 1, 2",
    "losses": "SELECT type, displaced AS author, count(*) AS deleted FROM displaced GROUP BY 1, 2",
    "base": "SELECT type, author, coalesce(lines, 0) AS lines, coalesce(deleted, 0) AS deleted"
    " FROM facts FULL OUTER JOIN losses USING (type, author)",
}

# --- facts --------------------------------------------------------------------

TYPED = {**ALL_VIEWS, "v_types": PATH_TYPES}


def _snapshot_facts(source: str) -> dict[str, str]:
    return {
        **TYPED,
        "taken": source,
        **_automaton("taken", "doc_id"),
        "counts": f"""SELECT doc_id, path, type, language, sum({COUNTABLE}) AS lines
            FROM flagged JOIN (SELECT doc_id, type, language FROM v_types) USING (doc_id) GROUP BY ALL""",
        "histogram": "SELECT doc_id, raw_author, count(*) AS n FROM taken GROUP BY ALL",
        "tops": """SELECT doc_id, raw_author AS top FROM (SELECT *, row_number() OVER
            (PARTITION BY doc_id ORDER BY n DESC, raw_author) AS rn FROM histogram) WHERE rn = 1""",
        "owned": "SELECT * FROM counts JOIN tops USING (doc_id) WHERE lines > 0 AND top <> 'unknown'",
        "named": _resolved("owned", "top", "author"),
        "facts": "SELECT doc_id, path, type, CAST(lines AS BIGINT) AS lines, author, language FROM named",
    }


SNAPSHOT_BY_PERSON = {
    **TYPED,
    "people": _resolved("v_lines", "raw_author", "person"),
    "taken": "SELECT * FROM people",
    **_automaton("taken", "doc_id"),
    "counts": f"""SELECT doc_id, path, type, language, sum({COUNTABLE}) AS lines
        FROM flagged JOIN (SELECT doc_id, type, language FROM v_types) USING (doc_id) GROUP BY ALL""",
    "tops": """SELECT doc_id, person FROM (SELECT doc_id, person, row_number() OVER
        (PARTITION BY doc_id ORDER BY count(*) DESC, person) AS rn FROM people GROUP BY 1, 2) WHERE rn = 1""",
}

AT_END = f"""SELECT l.* FROM v_lines l JOIN v_types USING (doc_id)
    WHERE is_code AND touch_seq <= {views.TO_SEQ}"""


def _window_facts(source: str, after: int | None) -> dict[str, str]:
    recent = "true" if after is None else f"touch_seq > {after}"
    return {
        **TYPED,
        "taken": source,
        **_automaton("taken", "doc_id"),
        "survivors": f"""SELECT doc_id, path, type, language, raw_author
            FROM flagged JOIN (SELECT doc_id, type, language FROM v_types) USING (doc_id)
            WHERE {COUNTABLE} = 1 AND {recent}""",
        "survivor_names": _resolved("survivors", "raw_author", "author"),
        "facts": "SELECT doc_id, path, type, count(*) AS lines, author, language FROM survivor_names GROUP BY ALL",
    }


HUNK_JOIN = """SELECT h.doc_id, h.path, h.commit_id, h.start, h.cnt, p.line_no, p.content, p.raw_author, h.deleting_author
    FROM v_hunks h JOIN v_lines p ON h.doc_id = p.doc_id AND p.line_no BETWEEN h.start AND h.start + h.cnt - 1"""


def _losses() -> dict[str, str]:
    renamed = {
        name: sql
        for name, sql in _automaton("removed", "doc_id, commit_id, start").items()
    }
    prefixed = {}
    for name, sql in renamed.items():
        for other in renamed:
            sql = sql.replace(f"FROM {other}", f"FROM h_{other}").replace(f" s, {other}", f" s, h_{other}")
        prefixed["h_" + name] = sql
    return {
        "removed": f"SELECT j.* FROM ({HUNK_JOIN}) j JOIN v_types USING (doc_id) WHERE is_code",
        **prefixed,
        "lost": f"""SELECT type, raw_author, deleting_author FROM h_flagged
            JOIN (SELECT doc_id, type FROM v_types) USING (doc_id) WHERE {COUNTABLE} = 1""",
        "lost_named": _resolved("lost", "raw_author", "author"),
        "lost_both": _resolved("lost_named", "deleting_author", "deleter"),
        "losses": "SELECT type, author, count(*) AS deleted FROM lost_both WHERE author <> deleter GROUP BY 1, 2",
    }


RANGE_BASE = {
    **_window_facts(AT_END, views.FROM_SEQ),
    **_losses(),
    "base": """SELECT type, author, coalesce(lines, 0) AS lines, coalesce(deleted, 0) AS deleted
        FROM (SELECT type, author, sum(lines) AS lines FROM facts GROUP BY 1, 2)
        FULL OUTER JOIN losses USING (type, author)""",
}

_TEXT = "replace(replace({}, chr(92), chr(92) || chr(92)), chr(34), chr(92) || chr(34))"


def _json(name: str, text: str) -> str:
    return f"""'"{name}":"' || {_TEXT.format(text)} || '"'"""


_TAIL = """ || ',"lines":' || lines || ',"percent":"' || printf('%.2f%%', share)
    || '","deleted":' || deleted || ',"sum":' || net || '}'"""
_COMMA = "CASE WHEN row_number() OVER ({}) = 1 THEN '' ELSE ',' END || "
_GROUPS = "SELECT * FROM sections WHERE section = 'by_author_and_type_total'"

NESTED = f"""
SELECT 1 AS place, 1 AS member, type, author,
  {_COMMA.format('PARTITION BY type ORDER BY lines DESC, author')} '{{' || {_json('author', 'author')} {_TAIL} AS line
  FROM sections WHERE section = 'by_author_and_type'
UNION ALL SELECT 1, 0, type, NULL, {_COMMA.format('ORDER BY lines DESC, type')} '{{' || {_json('type', 'type')}
  || ',"total_lines":' || lines || ',"authors":[' FROM ({_GROUPS})
UNION ALL SELECT 1, 2, type, NULL, ']}}' FROM ({_GROUPS})
UNION ALL SELECT 3, 0, type, NULL, {_COMMA.format('ORDER BY lines DESC, type')} '{{' || {_json('type', 'type')} {_TAIL}
  FROM sections WHERE section = 'by_type'
UNION ALL SELECT 5, 0, NULL, author, {_COMMA.format('ORDER BY net DESC, author')} '{{' || {_json('author', 'author')} {_TAIL}
  FROM sections WHERE section = 'by_author'
UNION ALL SELECT 0, 0, NULL, NULL, '{{"by_author_and_type":['
UNION ALL SELECT 2, 0, NULL, NULL, '],"by_type":['
UNION ALL SELECT 4, 0, NULL, NULL, '],"by_author":['
UNION ALL SELECT 6, 0, NULL, NULL, '],"total":{{"total_lines":' || lines || ',"total_deleted":' || deleted
  || ',"total_sum":' || net || '}}}}' FROM sections WHERE section = 'total'"""

MANIFESTS = {
    "m_from": "SELECT o_orderkey AS item_id, o_orderstatus AS content_id FROM orders",
    "m_to": """SELECT l_orderkey AS item_id, CASE WHEN min(l_linestatus) = max(l_linestatus)
        THEN min(l_linestatus) ELSE 'P' END AS content_id FROM lineitem GROUP BY 1""",
}
TOUCHED = """SELECT item_id FROM m_from f FULL OUTER JOIN m_to t USING (item_id)
    WHERE f.content_id IS DISTINCT FROM t.content_id"""

INVENTORY = f"SELECT doc_id FROM v_paths WHERE {IS_CODE} AND NOT {IS_SKIPPED}"

#: A row's number in the report; `value` is what authors are ordered by.
ROW_NO = """row_number() OVER (ORDER BY
    CASE section WHEN 'by_type' THEN 1 WHEN 'by_author' THEN 2 WHEN 'total' THEN 3 ELSE 0 END,
    CASE section WHEN 'by_author_and_type' THEN whole
        WHEN 'by_author_and_type_total' THEN lines WHEN 'by_type' THEN lines END DESC NULLS LAST,
    type NULLS FIRST, section = 'by_author_and_type',
    CASE section WHEN 'by_author' THEN {value} ELSE lines END DESC, author NULLS FIRST)"""
WITH_WHOLE = """(SELECT *, sum(CASE WHEN section = 'by_author_and_type' THEN lines END) OVER (PARTITION BY type) AS whole
    FROM sections)"""

# --- many rules, windows, revisions -------------------------------------------

REPOSITORY_PATHS = f"SELECT doc_id, path, doc_id % {views.REPOSITORIES} AS repo FROM v_paths"
_GLOB_TO_REGEX = r"""'^' || replace(replace(replace(replace(regexp_replace(g, '([.+^$(){}|\[\]])', '\\\1', 'g'),
    '**', chr(1)), '*', '[^/]*'), '?', '.'), chr(1), '.[^/]*') || '$'"""
PLAIN_RULES = {
    **FILE_VIEWS,
    "r_paths": REPOSITORY_PATHS,
    "r_lines": f"SELECT c_nationkey AS repo, c_custkey AS ord,"
    f" list_extract([{_quoted(views.GLOBS)}], CAST((c_custkey * 7 + c_nationkey) % {len(views.GLOBS)} + 1 AS INT)) AS said FROM customer",
    "r_rules": f"SELECT repo, ord, negate, {_GLOB_TO_REGEX} AS regex FROM"
    " (SELECT repo, ord, said LIKE '!%' AS negate, ltrim(said, '!') AS g FROM r_lines WHERE said NOT LIKE '%/')",
    "r_gone": f"""SELECT doc_id FROM r_paths JOIN r_rules USING (repo)
        WHERE regexp_matches(path, regex) OR regexp_matches({BASE}, regex)
        GROUP BY doc_id HAVING NOT arg_max(negate, ord)""",
}
#: The nested rules as expressions for whole paths, in the order of the view's rules:
#: expression, whether it is for directories only, whether it takes back.
NESTED_REGEX = (
    (r"^(.*/)?[^/]*\.py$", False, False), (r"^(.*/)?test_app\.py$", False, True), (r"^src/(.*/)?main$", True, False),
    (r"^src/app/[^/]*$", False, False), (r"^docs/.+$", False, False), (r"^docs/(.*/)?README\.md$", False, True),
    (r"^(.*/)?templates$", True, False), (r"^playbooks/(.*/)?templates$", False, True), (r"^(.*/)?[Dd]ockerfile$", False, False),
    (r"^(.*/)?main[^/]test\.go$", False, False), (r"^tests/(.*/)?[^/]*$", False, False), (r"^tests/(.*/)?conftest\.py$", False, True),
    (r"^(.*/)?build$", True, False), (r"^build/(.*/)?pom\.xml$", False, True), (r"^roles/a/tests/logo\.svg$", False, False),
)
_NESTED = ", ".join(
    f"({n}, {0 if not d else d.count('/') + 1}, '{e}', {only}, {back})"
    for n, ((d, _), (e, only, back)) in enumerate(zip(views.NESTED_RULES, NESTED_REGEX))
)
NESTED_RULES = {
    **FILE_VIEWS,
    "r_paths": REPOSITORY_PATHS,
    "r_kinds": f"SELECT * FROM (VALUES {_NESTED}) v(n, depth, regex, dir_only, negate)",
    "r_rules": f"SELECT c_nationkey AS repo, c_custkey AS ord, k.* FROM customer"
    f" JOIN r_kinds k ON k.n = (c_custkey * 7 + c_nationkey) % {len(views.NESTED_RULES)}",
    "r_steps": """SELECT doc_id, repo, array_to_string(s[1:i], '/') AS step, i < len(s) AS is_dir
        FROM (SELECT doc_id, repo, s, unnest(range(1, len(s) + 1)) AS i FROM (SELECT doc_id, repo, string_split(path, '/') AS s FROM r_paths))""",
    "r_gone": """SELECT DISTINCT doc_id FROM (SELECT doc_id, step FROM r_steps JOIN r_rules USING (repo)
        WHERE (is_dir OR NOT dir_only) AND regexp_matches(step, regex)
        GROUP BY doc_id, step HAVING NOT arg_max(negate, depth * 1000000000 + ord))""",
}
LEFT_PATHS = "SELECT doc_id, path, CAST(repo AS INTEGER) AS repo FROM r_paths WHERE doc_id NOT IN (SELECT doc_id FROM r_gone)"

_SPANS = ", ".join(f"('{w}', TIMESTAMP '{views.day(a)}', TIMESTAMP '{views.day(u)}')" for w, a, u in views.WINDOWS)
MANY_WINDOWS = {
    "v_touches": TOUCHES,
    "spans": f"SELECT * FROM (VALUES {_SPANS}) v(win, a, u)",
    "w_facts": """SELECT win, type, actor AS author, count(*) AS lines FROM (SELECT win, k, type, actor,
        row_number() OVER (PARTITION BY win, k ORDER BY ts DESC, event_id DESC) AS rn FROM v_touches JOIN spans ON ts > a AND ts <= u)
        WHERE rn = 1 GROUP BY ALL""",
    "w_chain": "SELECT *, lag(actor) OVER (PARTITION BY k ORDER BY ts, event_id) AS prev FROM v_touches",
    "w_losses": """SELECT win, type, prev AS author, count(*) AS deleted FROM w_chain JOIN spans ON ts > a AND ts <= u
        WHERE prev IS NOT NULL AND prev <> actor GROUP BY ALL""",
}
_LINE_SPANS = ", ".join(f"('{w}', {-1 if a is None else a})" for w, a in views.LINE_WINDOWS)
LINE_WINDOWS = {
    **TYPED,
    "taken": AT_END,
    **_automaton("taken", "doc_id"),
    "spans": f"SELECT * FROM (VALUES {_LINE_SPANS}) v(win, a)",
    "survivors": f"""SELECT win, doc_id, path, type, language, raw_author
        FROM flagged JOIN (SELECT doc_id, type, language FROM v_types) USING (doc_id) JOIN spans ON touch_seq > a
        WHERE {COUNTABLE} = 1""",
    "survivor_names": _resolved("survivors", "raw_author", "author"),
}
CHANGES = """SELECT concat(event_type, ':', json_extract_string(props, '$.k')) AS k, ts, event_id,
    CASE WHEN user_id % 7 <> 0 THEN user_id % 50 END AS content_id FROM events"""
_REVISIONS = ", ".join(f"({n}, TIMESTAMP '{views.day(n)}')" for n in views.REVISION_DAYS)
REVISIONS = {
    "changes": CHANGES,
    "revisions": f"SELECT * FROM (VALUES {_REVISIONS}) v(revision, r_ts)",
    "trees": """SELECT revision, k, content_id FROM (SELECT revision, k, content_id,
        row_number() OVER (PARTITION BY revision, k ORDER BY ts DESC, event_id DESC) AS rn FROM changes JOIN revisions ON ts <= r_ts)
        WHERE rn = 1 AND content_id IS NOT NULL""",
}

ORACLES: dict[str, str] = {
    "net_report": _report(
        NET_BASE, f"SELECT section, type, author, lines, share, {PERCENT} AS percent, deleted, net FROM sections"
    ),
    "net_by_pair": _with(
        NET_BASE,
        "SELECT type, author, CAST(lines AS BIGINT) AS lines, CAST(deleted AS BIGINT) AS deleted,"
        " CAST(lines - deleted AS BIGINT) AS net FROM base",
    ),
    "last_touch_window": _with({"v_touches": TOUCHES}, LAST_TOUCH),
    "last_touch_from_start": _with(
        {"v_touches": TOUCHES},
        "SELECT k, ts, event_id, type, actor FROM v_touches QUALIFY"
        " row_number() OVER (PARTITION BY k ORDER BY ts DESC, event_id DESC) = 1",
    ),
    "displacements": _with(
        {"v_touches": TOUCHES, "d": DISPLACEMENTS}, "SELECT k, ts, event_id, actor, displaced FROM d"
    ),
    "displacement_losses": _with(
        {"v_touches": TOUCHES, "d": DISPLACEMENTS},
        "SELECT type, displaced AS author, count(*) AS deleted FROM d GROUP BY 1, 2",
    ),
    "share_by_group": _with(
        EVENT_BASE,
        f"""SELECT type, author, lines, CAST(group_lines AS BIGINT) AS group_lines, {_share('lines', 'group_lines')} AS share
        FROM (SELECT *, sum(lines) OVER (PARTITION BY type) AS group_lines FROM base)""",
    ),
    "rollup_report": _with({**EVENT_BASE, "rolled": ROLLUP}, "SELECT type, author, level, lines FROM rolled"),
    "share_text": _report(EVENT_BASE, f"SELECT section, type, author, share, {PERCENT} AS percent FROM sections"),
    "ordered_sections": _report(EVENT_BASE, "SELECT section, type, author, lines, share FROM sections"),
    "path_parts": _path_query(base=BASE, ext=EXT, n_segments="len(string_split(path, '/'))"),
    "path_language": _path_query(language=LANGUAGE),
    "path_is_code": _path_query(is_code=IS_CODE),
    "path_skip_dir": _path_query(skipped=IS_SKIPPED),
    "path_build": _path_query(is_build=IS_BUILD),
    "path_test": _path_query(test_name=IS_TEST_NAME, is_test=IS_TEST),
    "path_resource": _path_query(is_resource=IS_RESOURCE),
    "path_type": _path_query(type=TYPE, language=TYPE_LANGUAGE),
    "path_type_rollup": _with(
        {
            **FILE_VIEWS,
            "base": f"SELECT {TYPE} AS type, {TYPE_LANGUAGE} AS author, count(*) AS lines, 0 AS deleted"
            " FROM v_paths GROUP BY 1, 2",
            "rolled": ROLLUP,
        },
        "SELECT type, author AS language, level, lines AS files FROM rolled",
    ),
    "ignore_filter": _with(FILE_VIEWS, f"SELECT doc_id, path FROM v_paths WHERE NOT {_ignored()}"),
    "tracked_semi": _with(
        FILE_VIEWS, "SELECT doc_id, path FROM v_paths WHERE doc_id IN (SELECT doc_id FROM labels)"
    ),
    "file_inventory": _with(
        FILE_VIEWS,
        f"SELECT doc_id, path FROM v_paths WHERE {IS_CODE} AND NOT {IS_SKIPPED} AND NOT {_ignored()}"
        " AND doc_id IN (SELECT doc_id FROM labels)",
    ),
    "touched_paths": _with(MANIFESTS, TOUCHED),
    "touched_paths_from_start": _with(MANIFESTS, "SELECT item_id FROM m_to"),
    "revision_filter": "SELECT doc_id, source, n_chars FROM documents WHERE source = 'src1'",
    "split_into_lines": _with(
        {**FILE_VIEWS, "v_plain": PLAIN_LINES}, "SELECT doc_id, n + 1 AS line_no, l AS content FROM v_plain"
    ),
    "line_prefix_and_blank": _with(
        {**LINE_VIEWS, "ws": f"SELECT {_WS} AS ws"},
        "SELECT doc_id, line_no, trim(content, ws) = '' AS blank,"
        r" regexp_matches(ltrim(content, ws), '^(//|#|--|\*)') AS comment FROM v_lines, ws",
    ),
    "line_countable": _with(
        {**LINE_VIEWS, "v_types": PATH_TYPES, **_automaton("v_lines", "doc_id")},
        f"SELECT doc_id, line_no, type, ({COUNTABLE}) = 1 AS countable"
        " FROM flagged JOIN (SELECT doc_id, type FROM v_types) USING (doc_id)",
    ),
    "line_counts": _with(
        {**LINE_VIEWS, "v_types": PATH_TYPES, **_automaton("v_lines", "doc_id")},
        f"""SELECT doc_id, count(*) AS n_lines, CAST(sum(filled) AS BIGINT) AS n_filled,
        CAST(sum(code) AS BIGINT) AS n_code, CAST(sum({COUNTABLE}) AS BIGINT) AS countable
        FROM flagged JOIN (SELECT doc_id, type FROM v_types) USING (doc_id) GROUP BY 1""",
    ),
    "line_countable_in_runs": _with(
        {**LINE_VIEWS, "v_types": PATH_TYPES, **_automaton("v_lines", "doc_id")},
        f"SELECT doc_id, line_no, type, ({COUNTABLE}) = 1 AS countable"
        " FROM flagged JOIN (SELECT doc_id, type FROM v_types) USING (doc_id)",
    ),
    "line_counts_in_runs": _with(
        {**LINE_VIEWS, "v_types": PATH_TYPES, **_automaton("v_lines", "doc_id")},
        f"""SELECT doc_id, count(*) AS n_lines, CAST(sum(filled) AS BIGINT) AS n_filled,
        CAST(sum(code) AS BIGINT) AS n_code, CAST(sum({COUNTABLE}) AS BIGINT) AS countable
        FROM flagged JOIN (SELECT doc_id, type FROM v_types) USING (doc_id) GROUP BY 1""",
    ),
    "file_line_counts": _with(
        {**LINE_VIEWS, "v_types": PATH_TYPES, **_automaton("v_lines", "doc_id")},
        f"""SELECT doc_id, CAST(sum({COUNTABLE}) AS BIGINT) AS countable
        FROM flagged JOIN (SELECT doc_id, type FROM v_types) USING (doc_id) GROUP BY 1""",
    ),
    "alias_dimension": _with(
        {
            "people": "SELECT c_custkey, c_name, c_mktsegment || '-' || c_nationkey AS shared FROM customer",
            "all_names": """SELECT 'name' AS kind, lower(c_name) AS alias_lower, c_name AS canonical, c_custkey AS ord FROM people
            UNION ALL SELECT 'name', lower(shared), c_name, c_custkey FROM people
            UNION ALL SELECT 'email', lower(c_name || '@x.org'), c_name, c_custkey FROM people
            UNION ALL SELECT 'email', lower(shared || '@x.org'), c_name, c_custkey FROM people""",
        },
        "SELECT kind, alias_lower, arg_max(canonical, ord) AS canonical FROM all_names GROUP BY 1, 2",
    ),
    "identity_resolve": _with(
        {**ALL_VIEWS, "named": _resolved("v_lines", "raw_author", "author")},
        "SELECT doc_id, line_no, raw_author, author FROM named",
    ),
    "author_histogram": _with(LINE_VIEWS, "SELECT doc_id, raw_author, count(*) AS n_lines FROM v_lines GROUP BY 1, 2"),
    "dominant_author": _with(
        {**LINE_VIEWS, "h": "SELECT doc_id, raw_author, count(*) AS n FROM v_lines GROUP BY 1, 2"},
        "SELECT doc_id, raw_author FROM h QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, raw_author) = 1",
    ),
    "snapshot_facts": _with(_snapshot_facts("SELECT * FROM v_lines"), "SELECT * FROM facts"),
    "snapshot_facts_by_person": _with(
        SNAPSHOT_BY_PERSON,
        "SELECT doc_id, path, type, CAST(lines AS BIGINT) AS lines, person AS author, language"
        " FROM counts JOIN tops USING (doc_id) WHERE lines > 0 AND person <> 'unknown'",
    ),
    "snapshot_report": _report(
        {
            **_snapshot_facts(f"SELECT * FROM v_lines WHERE doc_id IN ({INVENTORY})"),
            "base": "SELECT type, author, sum(lines) AS lines, 0 AS deleted FROM facts GROUP BY 1, 2",
        },
        f"SELECT section, type, author, lines, share, {PERCENT} AS percent FROM sections",
    ),
    "snapshot_inventory_report": _report(
        {
            **_snapshot_facts(
                f"SELECT * FROM v_lines WHERE doc_id IN ({INVENTORY} AND NOT {_ignored()}"
                " AND doc_id IN (SELECT doc_id FROM labels))"
            ),
            "base": "SELECT type, author, sum(lines) AS lines, 0 AS deleted FROM facts GROUP BY 1, 2",
        },
        f"SELECT section, type, author, lines, share, {PERCENT} AS percent FROM sections",
    ),
    "window_line_facts": _with(_window_facts(AT_END, views.FROM_SEQ), "SELECT * FROM facts"),
    "window_line_facts_touched": _with(
        _window_facts(f"SELECT * FROM ({AT_END}) WHERE doc_id IN (SELECT doc_id FROM labels)", None),
        "SELECT * FROM facts",
    ),
    "hunk_interval_join": _with(ALL_VIEWS, f"SELECT * EXCLUDE (path) FROM ({HUNK_JOIN})"),
    "hunks_without_parent": _with(
        {
            **FILE_VIEWS,
            "v_hunks": HUNKS,
            "named": "SELECT h.* EXCLUDE (path), h.path AS had, CASE WHEN h.commit_id < 10 THEN h.path ELSE "
            + RENAMED_PATH
            + " END AS path FROM v_hunks h",
        },
        "SELECT * EXCLUDE (had) FROM named WHERE path <> had",
    ),
    "hunk_losses": _with({**TYPED, **_losses()}, "SELECT type, author, deleted FROM losses"),
    "range_report": _report(
        RANGE_BASE, f"SELECT section, type, author, lines, share, {PERCENT} AS percent, deleted, net FROM sections"
    ),
    "flat_report": _report(
        NET_BASE,
        f"SELECT section AS category, type, author, lines, {PERCENT} AS percent, deleted, net AS sum FROM sections",
    ),
    "display_report": _report(
        NET_BASE,
        f"""SELECT section, coalesce(type, '') AS type,
        CASE WHEN section = 'by_author_and_type_total' THEN '(total)' ELSE coalesce(CAST(author AS VARCHAR), '') END AS author,
        {PERCENT} AS percent, CAST(lines AS VARCHAR) AS lines, CAST(deleted AS VARCHAR) AS deleted,
        CAST(net AS VARCHAR) AS net FROM sections""",
    ),
    "nested_report": _report(RANGE_BASE, NESTED),
    "blame_dump_parse": _with(
        {**FILE_VIEWS, "v_plain": PLAIN_LINES},
        f"""SELECT doc_id, sha1(doc_id || ':' || (n + 1)) AS commit_id, n + 1 AS line_no, {AUTHOR_CASE} AS author,
        (doc_id*7 + n*13) % 100 <= {views.FROM_SEQ} AS boundary, l AS content FROM v_plain""",
    ),
    "patch_log_parse": _with(
        {**FILE_VIEWS, "v_types": PATH_TYPES},
        """SELECT lpad(CAST(doc_id AS VARCHAR), 40, '0') AS commit_id, 'Author ' || (doc_id % 7) AS deleting_author, path,
        1 + doc_id % 5 AS start, 2 + doc_id % 4 AS cnt FROM v_types WHERE is_code
        UNION ALL SELECT lpad(CAST(doc_id AS VARCHAR), 40, '0'), 'Author ' || (doc_id % 7), path, 40, 1
        FROM v_types WHERE is_code""",
    ),
    "patch_log_lines_parse": _with(
        {
            **FILE_VIEWS,
            "v_types": PATH_TYPES,
            "c": f"SELECT *, doc_id - doc_id % {views.COMMIT_DOCUMENTS} AS first FROM v_types WHERE is_code",
        },
        """SELECT lpad(CAST(first AS VARCHAR), 40, '0') AS commit_id, 'Author ' || (first % 7) AS deleting_author, path,
        1 + doc_id % 5 AS start, 2 + doc_id % 4 AS cnt FROM c
        UNION ALL SELECT lpad(CAST(first AS VARCHAR), 40, '0'), 'Author ' || (first % 7), path, 40, 1 FROM c""",
    ),
    "line_counts_reused": _with(
        {
            **FILE_VIEWS,
            "v_plain": PLAIN_LINES,
            "taken": "SELECT doc_id, n + 1 AS line_no, l AS content FROM v_plain",
            **_automaton("taken", "doc_id"),
            "counted": "SELECT doc_id, count(*) AS n_lines, CAST(sum(filled) AS BIGINT) AS n_filled, CAST(sum(code) AS BIGINT) AS n_code"
            " FROM flagged GROUP BY 1",
        },
        "SELECT c.*, d.text IN (SELECT text FROM documents WHERE source = 'src1') AS reused FROM counted c JOIN documents d USING (doc_id)",
    ),
    "numbered_sections": _report(EVENT_BASE, f"SELECT {ROW_NO.format(value='lines')} AS row_no, section, type, author, lines FROM {WITH_WHOLE}"),
    "numbered_range_report": _report(
        RANGE_BASE,
        f"SELECT {ROW_NO.format(value='net')} AS row_no, section, type, author, lines, share, {PERCENT} AS percent, deleted, net FROM {WITH_WHOLE}",
    ),
    "window_line_facts_changed": _with(
        _window_facts(
            f"SELECT * FROM ({AT_END}) WHERE doc_id IN (SELECT doc_id FROM v_lines WHERE touch_seq > {views.FROM_SEQ} AND touch_seq <= {views.TO_SEQ})",
            views.FROM_SEQ,
        ),
        "SELECT * FROM facts",
    ),
    "ignore_rules_table": _with(PLAIN_RULES, LEFT_PATHS),
    "ignore_rules_nested": _with(NESTED_RULES, LEFT_PATHS),
    "net_by_windows": _with(
        MANY_WINDOWS,
        """SELECT win AS "window", type, author, coalesce(lines, 0)::BIGINT AS lines, coalesce(deleted, 0)::BIGINT AS deleted,
        (coalesce(lines, 0) - coalesce(deleted, 0))::BIGINT AS net FROM w_facts FULL OUTER JOIN w_losses USING (win, type, author)""",
    ),
    "line_facts_by_windows": _with(
        LINE_WINDOWS,
        'SELECT win AS "window", doc_id, path, type, count(*) AS lines, author, language FROM survivor_names GROUP BY ALL',
    ),
    "tree_at_revisions": _with(REVISIONS, "SELECT revision, k, content_id FROM trees"),
    "touched_between_revisions": _with(
        REVISIONS,
        f"""SELECT k FROM (SELECT k, content_id FROM trees WHERE revision = {views.REVISION_DAYS[0]}) f
        FULL OUTER JOIN (SELECT k, content_id FROM trees WHERE revision = {views.REVISION_DAYS[-2]}) t USING (k)
        WHERE f.content_id IS DISTINCT FROM t.content_id""",
    ),
}
