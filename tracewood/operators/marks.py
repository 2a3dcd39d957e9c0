"""What stands above and around a definition in its source, and small readings of paths and numbers.

A definition's place is a byte offset into its file's text. All are column expressions that stay in the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewood.operators.unused import is_test_symbol

# Virtual methods that one engine calls by name.
ENGINE_METHODS = (
    "_ready _process _physics_process _input _unhandled_input _unhandled_key_input _shortcut_input _gui_input _notification _draw _enter_tree _exit_tree _init _initialize _finalize "
    "_to_string _get _set _get_property_list _validate_property _can_drop_data _drop_data _get_drag_data _make_custom_tooltip _has_point _get_minimum_size _integrate_forces _run _get_configuration_warnings"
).split()


def _around(text: Column, start: Column) -> tuple[Column, Column, Column]:
    """The part of the definition's line before it, the rest of the line, and the lines above, nearest first."""
    raw = F.encode(text, "utf-8")
    before = F.split(F.decode(F.substring(raw, F.lit(1), start), "utf-8"), "\n")
    rest = F.regexp_extract(F.decode(F.substring(raw, start + 1, F.length(raw)), "utf-8"), r"^([^\n]*)", 1)
    above = F.reverse(F.slice(before, 1, F.size(before) - 1))
    return F.element_at(before, -1), rest, above


def _leading(lines: Column, test) -> Column:
    """The lines up to the first that fails a test."""
    fails = F.array_position(F.transform(lines, lambda s: ~test(s)), True)
    return F.when(fails == 0, lines).otherwise(F.slice(lines, F.lit(1), F.greatest(fails - 1, F.lit(0)).cast("int")))


def _marks(line: Column) -> Column:
    return line.rlike(r"^\s*(?:#\[|@|\[)")


def has_test_attribute(text: Column, start: Column) -> Column:
    """Whether an attribute before the definition on its line, or on the lines directly above, names a test to run; a condition
    that only compiles code for tests (``cfg(...)``) doesn't. Null texts and places have none."""
    names = lambda s: ~F.lower(s).contains("cfg(") & (F.lower(s).contains("test") | F.lower(s).contains("[fact") | F.lower(s).contains("[theory"))
    inline, _, above = _around(text, start)
    return F.coalesce((inline.rlike(r"@|\[") & names(inline)) | F.exists(_leading(above, _marks), names), F.lit(False))


def is_test_node(file: Column, name: Column, text: Column, start: Column) -> Column:
    """By path, file or name, else by a test attribute."""
    return is_test_symbol(file, name) | has_test_attribute(text, start)


def is_annotated(text: Column, start: Column) -> Column:
    """Whether a decorator or attribute stands on a definition or it is marked as an override: a framework or an interface calls it."""
    inline, rest, above = _around(text, start)
    nearest = F.try_element_at(F.filter(above, lambda s: s.rlike(r"\S")), F.lit(1))
    return F.coalesce(inline.rlike(r"@|#\[") | F.concat(inline, rest).rlike(r"(?:^|\s)override(?:\s|$)"), F.lit(False)) | F.coalesce(_marks(nearest), F.lit(False))


def in_trait_impl(text: Column, start: Column) -> Column:
    """Whether a Rust definition lies in ``impl Trait for Type``: the nearest line above that is indented less opens one."""
    inline, rest, above = _around(text, start)
    indent = lambda s: F.length(F.regexp_extract(s, r"^(\s*)", 1))
    own = indent(F.concat(inline, rest))
    opener = F.try_element_at(F.filter(above, lambda s: s.rlike(r"\S") & (indent(s) < own)), F.lit(1))
    return F.coalesce(opener.rlike(r"^\s*(?:unsafe )?impl.* for "), F.lit(False))


def is_engine_method(file: Column, name: Column) -> Column:
    return file.endswith(".gd") & name.isin(ENGINE_METHODS)


def exempt(defs: DataFrame, files: DataFrame) -> DataFrame:
    """(node): definitions (node, file, name, start) that something outside the tree calls by what stands around them: annotated
    ones, methods of trait implementations (Rust) and engine callbacks. ``files``: file, text."""
    met = defs.select("node", "file", "name", "start").join(files.select("file", "text"), "file", "left")
    rust = F.lower(F.col("file")).endswith(".rs") & in_trait_impl(F.col("text"), F.col("start"))
    return met.filter(is_annotated(F.col("text"), F.col("start")) | rust | is_engine_method(F.col("file"), F.col("name"))).select("node").distinct()


def normalized(path: Column) -> Column:
    """A path without '.', empty parts and what '..' takes back; a leading slash stays."""
    parts = F.split(F.regexp_replace(path, r"\\", "/"), "/")
    step = lambda acc, p: F.when((p == "") | (p == "."), acc).when(p == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(p)))
    return F.concat(F.when(path.startswith("/"), "/").otherwise(""), F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/"))


def within(path: Column) -> Column:
    """A relative path normalised, or null where it is absolute or leaves the tree."""
    parts = F.filter(F.split(F.regexp_replace(path, r"\\", "/"), "/"), lambda p: (p != "") & (p != "."))
    depth = F.aggregate(parts, F.array(F.lit(0), F.lit(0)), lambda a, p: F.array(a[0] + F.when(p == "..", -1).otherwise(1), F.least(a[1], a[0] + F.when(p == "..", -1).otherwise(1))))
    return F.when(~path.startswith("/") & ~path.rlike(r"^[A-Za-z]:") & (depth[1] >= 0), normalized(path))


def asm_number(c: Column) -> Column:
    """An assembler's number: decimal, ``$`` hexadecimal or ``%`` binary, with a minus or not; else null, as is one beyond 64 bits."""
    s = F.trim(c)
    sign = F.when(s.startswith("-"), -1).otherwise(1)
    bare = F.regexp_replace(s, r"^-", "")
    digits = lambda base, most: F.when(F.length(F.regexp_replace(F.substring(bare, 2, 1 << 20), "^0+", "")) <= most, F.conv(F.substring(bare, 2, 1 << 20), base, 10).try_cast("long"))
    return sign * F.when(bare.rlike(r"^\$[0-9a-fA-F]+$"), digits(16, 16)).when(bare.rlike(r"^%[01]+$"), digits(2, 64)).when(bare.rlike(r"^\+?[0-9]+$"), bare.try_cast("long"))
