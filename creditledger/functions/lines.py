"""Line classification that needs no other line.

A block comment makes a line depend on the lines before it through one bit:
inside a comment or not. Each line is therefore summed up by what it does for
either value of that bit, packed into one integer:

    bit 0   counts when reached outside a comment
    bit 1   counts when reached inside a comment
    bit 2   leaves a comment open when reached outside
    bit 3   leaves a comment open when reached inside
    bit 4   is not blank

Only the left end has to be trimmed: blankness, prefixes and "some code before
the marker" do not depend on trailing white space.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from creditledger.functions.fixed_values import LINE_COMMENT_PREFIXES, WHITE_SPACE

_SPACES = "".join(f"\\u{ord(c):04x}" for c in WHITE_SPACE)


# The rules are SQL text, shared by the line tables, where they are applied to a
# column, and by whole files, where they are applied inside an array.


def _trimmed(text: str) -> str:
    return f"TRIM(LEADING '{_SPACES}' FROM {text})"


def _comment(trimmed: str) -> str:
    return "(" + " OR ".join(f"startswith({trimmed}, '{p}')" for p in LINE_COMMENT_PREFIXES) + ")"


def _carries_code(text: str) -> str:
    return f"({_trimmed(text)} <> '' AND NOT {_comment(_trimmed(text))})"


def _parts(t: str) -> str:
    """What the code of a line looks at: the trimmed line, the places of its first
    open and close marker (0 if none) and the text after the open. `contains`
    compares bytes; the slower search by character only follows a hit."""
    return f"""named_struct(
        't', {t},
        'opened', CASE WHEN contains({t}, '/*') THEN instr({t}, '/*') ELSE 0 END,
        'closed', CASE WHEN contains({t}, '*/') THEN instr({t}, '*/') ELSE 0 END,
        'after_open', CASE WHEN contains({t}, '/*') THEN substr({t}, instr({t}, '/*') + 2) END)"""


def _code(p: str) -> str:
    comment = _comment(f"{p}.t")
    closes_again = f"coalesce(contains({p}.after_open, '*/'), false)"
    after_both = f"substr({p}.after_open, instr({p}.after_open, '*/') + 2)"
    after_close = f"substr({p}.t, {p}.closed + 2)"
    return f"""CASE
        WHEN {p}.opened = 0 AND {p}.closed = 0
        THEN CASE WHEN {p}.t = '' THEN 8 WHEN {comment} THEN 8 + 16 ELSE 1 + 8 + 16 END
        ELSE 16
          + IF(NOT {comment} AND ({p}.opened <> 1 OR ({closes_again} AND {_carries_code(after_both)})), 1, 0)
          + IF({p}.closed > 0 AND {_carries_code(after_close)}, 2, 0)
          + IF({p}.opened > 0 AND NOT {comment} AND NOT {closes_again}, 4, 0)
          + IF({p}.closed = 0, 8, 0)
        END"""


def left_trimmed(column: str) -> Column:
    return F.expr(_trimmed(column))


def is_line_comment(column: str) -> Column:
    """For a left-trimmed column."""
    return F.expr(_comment(column))


def with_line_code(df: DataFrame, content: str, into: str) -> DataFrame:
    """Adds the packed code of a line, in steps so that nothing is computed twice."""
    return (
        df.selectExpr("*", f"{_trimmed(content)} AS _trimmed")
        .selectExpr("*", f"{_parts('_trimmed')} AS _parts")
        .selectExpr("*", f"{_code('_parts')} AS {into}")
        .drop("_trimmed", "_parts")
    )


def bit(code: Column, position: int) -> Column:
    return F.shiftright(code, position).bitwiseAND(F.lit(1))


def split_lines(content: Column) -> Column:
    return F.split(content, "\n", -1)


def countable_lines_in_text(content: str, type_: str) -> Column:
    """Countable lines of a whole file held in one column, folded in place.

    Documentation counts every line that is not blank, other types skip
    comments. No line leaves its row, so counting a table of files needs no
    shuffle. Text without block markers, the usual case, is a plain filter.
    """
    trimmed = f"transform(split({content}, '\n', -1), l -> {_trimmed('l')})"
    folded = f"""aggregate(
        transform(transform({trimmed}, t -> {_parts('t')}), p -> {_code('p')}),
        named_struct('inside', 0, 'n', 0L),
        (acc, code) -> named_struct(
            'inside', shiftright(code, 2 + acc.inside) & 1,
            'n', acc.n + (shiftright(code, acc.inside) & 1)),
        acc -> acc.n)"""
    return F.expr(f"""CASE
        WHEN {type_} = 'documentation' THEN CAST(size(filter({trimmed}, t -> t <> '')) AS BIGINT)
        WHEN contains({content}, '/*') OR contains({content}, '*/') THEN {folded}
        ELSE CAST(size(filter({trimmed}, t -> t <> '' AND NOT {_comment('t')})) AS BIGINT)
        END""")
