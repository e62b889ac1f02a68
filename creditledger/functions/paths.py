"""Path classification as Column expressions.

Everything here is built-in string work on one column: membership tests on the
extension and the base name, and one anchored alternation per family of names.
The predicates stay JVM-side and move below joins.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import Column
from pyspark.sql import functions as F

from creditledger.functions import fixed_values as fv


def _one_of(names: Iterable[str]) -> str:
    found = [re.escape(name) for name in names]
    return "(?:" + "|".join(found) + ")" if found else "(?!)"


@dataclass(frozen=True)
class PathRules:
    """The word lists that paths are classified by; those of the measure unless others
    are given. Extensions, base names and segments are in lower case."""

    languages: Mapping[str, str] = field(default_factory=lambda: dict(fv.LANGUAGE_BY_EXTENSION), hash=False)
    script_extensions: Sequence[str] = fv.SCRIPT_EXTENSIONS
    documentation_extensions: Sequence[str] = fv.DOCUMENTATION_EXTENSIONS
    code_basenames: Sequence[str] = fv.CODE_BASENAMES
    code_prefixes: Sequence[str] = fv.CODE_BASE_PREFIXES
    code_suffixes: Sequence[str] = fv.CODE_BASE_SUFFIXES
    build_extensions: Sequence[str] = fv.QUADLET_EXTENSIONS + fv.BUILD_EXTENSIONS
    build_basenames: Sequence[str] = fv.BUILD_BASENAMES + fv.COMPOSE_BASENAMES
    test_segments: Sequence[str] = fv.TEST_SEGMENTS
    resource_segments: Sequence[str] = fv.RESOURCE_SEGMENTS
    script_test_extensions: Sequence[str] = fv.SCRIPT_TEST_EXTENSIONS
    jvm_test_extensions: Sequence[str] = fv.JVM_TEST_EXTENSIONS
    skipped_directories: Sequence[str] = fv.SKIPPED_DIRECTORIES
    skipped_suffix: str = fv.SKIPPED_DIRECTORY_SUFFIX

    # Matched against the lower-cased base name.

    @cached_property
    def known_extension(self) -> str:
        return rf"{_one_of(self.languages)}\z"

    @cached_property
    def script(self) -> str:
        return rf"{_one_of(self.script_extensions)}\z"

    @cached_property
    def documentation(self) -> str:
        return rf"{_one_of(self.documentation_extensions)}\z"

    @cached_property
    def container(self) -> str:
        return rf"^{_one_of(self.code_prefixes)}|{_one_of(self.code_suffixes)}\z"

    @cached_property
    def code(self) -> str:
        return rf"{self.known_extension}|^{_one_of(self.code_basenames)}\z|{self.container}"

    @cached_property
    def build(self) -> str:
        names = rf"{_one_of(self.build_extensions)}\z|^{_one_of(self.build_basenames)}\z"
        return rf"(?s){names}|^tsconfig.*\.json\z|{self.container}"

    @cached_property
    def test(self) -> str:
        scripts = rf"\.(?:test|spec){_one_of(self.script_test_extensions)}\z"
        return rf"(?s)_test\.go\z|_test\.py\z|^test_.*\.py\z|{scripts}"

    # Matched against the base name as it is: "Latest.java" is not a test.

    @cached_property
    def cased_test(self) -> str:
        return rf"Tests?{_one_of(self.jvm_test_extensions)}\z|^conftest\.py\z"

    # Matched against the whole path.

    @cached_property
    def skipped(self) -> str:
        suffix = rf"|{re.escape(self.skipped_suffix)}/" if self.skipped_suffix else ""
        return rf"(?:^|/){_one_of(self.skipped_directories)}/{suffix}"

    @cached_property
    def language_map(self) -> str:
        quoted = lambda text: "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"
        pairs = ", ".join(f"{quoted(ext)}, {quoted(name)}" for ext, name in self.languages.items())
        return f"CAST(map({pairs}) AS map<string,string>)"


RULES = PathRules()
_WORKFLOW = r"(?:^|/)\.github/"


# The letters that stand for control characters in a quoted path.
ESCAPES = {"a": 7, "b": 8, "t": 9, "n": 10, "v": 11, "f": 12, "r": 13}


def unquoted_path(path: Column) -> Column:
    """Undo quoting: "a/\\303\\244.md" holds its bytes as octal escapes. Escapes are
    read from left to right; bytes that are no UTF-8 become replacement characters."""
    inner = F.regexp_extract(path, r'(?s)^"(.*)"$', 1)
    pieces = F.regexp_extract_all(inner, F.lit(r"(?s)(\\[0-7]{3}|\\.|[^\\]+|\\)"), F.lit(1))

    def as_hex(piece: Column) -> Column:
        octal = F.lpad(F.conv(F.substring(piece, 2, 3), 8, 16), 2, "0")
        letter = F.when(piece.rlike(r"^\\[0-7]{3}$"), F.right(octal, F.lit(2)))
        for name, code in ESCAPES.items():
            letter = letter.when(piece == "\\" + name, F.lit(f"{code:02X}"))
        # Any other character after a backslash stands for itself.
        bare = F.regexp_replace(piece, r"(?s)^\\(.)$", "$1")
        return letter.otherwise(F.hex(F.encode(bare, "UTF-8")))

    bytes_ = F.unhex(F.array_join(F.transform(pieces, as_hex), ""))
    text = F.make_valid_utf8(bytes_.cast("string"))
    return F.when(path.startswith('"'), text).otherwise(path)


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def extension(path: Column) -> Column:
    """Lower-cased text from the last dot of the last path element, or ''."""
    return F.lower(F.regexp_extract(path, r"(\.[^./]*)\z", 1))


def segments(path: Column) -> Column:
    return F.split(path, "/")


def _has_segment(path: Column, names: Iterable[str]) -> Column:
    return F.lower(path).rlike(rf"(?:^|/){_one_of(names)}(?:/|\z)")


def language(path: Column, rules: PathRules = RULES) -> Column:
    return F.coalesce(F.try_element_at(F.expr(rules.language_map), extension(path)), F.lit("other"))


def _base_is(path: Column, names: str) -> Column:
    return F.lower(base_name(path)).rlike(names)


def is_code_file(path: Column, rules: PathRules = RULES) -> Column:
    """The gate for every report: a known extension or a container/lint file."""
    return _base_is(path, rules.code)


def in_skipped_directory(path: Column, rules: PathRules = RULES) -> Column:
    """True if any directory above the file is one that an inventory leaves out."""
    return path.rlike(rules.skipped)


def is_skipped_name(directory: str, rules: PathRules = RULES) -> bool:
    return directory in rules.skipped_directories or bool(rules.skipped_suffix) and directory.endswith(rules.skipped_suffix)


def is_build_file(path: Column, rules: PathRules = RULES) -> Column:
    return _base_is(path, rules.build) | path.rlike(_WORKFLOW)


def is_test_filename(path: Column, rules: PathRules = RULES) -> Column:
    return _base_is(path, rules.test) | base_name(path).rlike(rules.cased_test)


def is_test_path(path: Column, rules: PathRules = RULES) -> Column:
    return is_test_filename(path, rules) | _has_segment(path, rules.test_segments)


def is_resource_path(path: Column, rules: PathRules = RULES) -> Column:
    return _has_segment(path, rules.resource_segments)


def file_type(path: Column, rules: PathRules = RULES) -> Column:
    test, resource = is_test_path(path, rules), is_resource_path(path, rules)
    return (
        F.when(is_build_file(path, rules), "build")
        .when(_base_is(path, rules.script), "scripts")
        .when(_base_is(path, rules.documentation), "documentation")
        .when(~_base_is(path, rules.known_extension), "other")
        .when(test & resource, "test_resources")
        .when(test, "test_code")
        .when(resource, "main_resources")
        .otherwise("main_code")
    )


def file_language(path: Column, rules: PathRules = RULES) -> Column:
    """Language as reported with the type: scripts are shell, documentation is text."""
    return (
        F.when(is_build_file(path, rules), language(path, rules))
        .when(_base_is(path, rules.script), "shell")
        .when(_base_is(path, rules.documentation), "text")
        .otherwise(language(path, rules))
    )
