"""Column functions on names, routes, diagnostics and stack-trace lines."""

from __future__ import annotations

import base64
import json
import zlib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanweave.functions import frames

LAYERS = ("Api", "Application", "Contracts", "Domain", "Infrastructure")


def route_combine(*parts: Column) -> Column:
    """Segments of all parts, blanks dropped, behind one leading slash."""
    segments = F.filter(F.split(F.concat_ws("/", *parts), "/"), lambda x: F.trim(x) != "")
    return F.concat(F.lit("/"), F.array_join(segments, "/"))


def slug(name: Column) -> Column:
    """File name of a title: letters and digits in lower case, else one dash."""
    return F.regexp_replace(F.regexp_replace(F.lower(name), r"[^\p{L}\p{Nd}]+", "-"), r"^-+|-+$", "")


def selector(text: Column) -> Column:
    """A selector as it is compared: trimmed, upper case, double blanks single."""
    return F.replace(F.upper(F.trim(text)), F.lit("  "), F.lit(" "))


def access_letters(access: Column) -> Column:
    """The letters of an access flag, upper case, sorted: ``WR`` equals ``RW``."""
    return F.array_join(F.array_sort(F.filter(F.split(F.upper(access), ""), lambda c: c.rlike(r"\p{L}"))), "")


def module_of_name(name: Column) -> Column:
    """Second dot segment of an assembly or type name, or null."""
    return F.try_element_at(F.split(name, r"\."), F.lit(2))


def diagnostic_file(text: Column) -> Column:
    """File before the ``:line`` at the end of a diagnostic, or empty."""
    return F.regexp_extract(text, r"([^ ]*):\s*\d+\s*$", 1)


def diagnostic_line(text: Column) -> Column:
    """Line at the end of a diagnostic, or 0."""
    return F.coalesce(F.try_to_number(F.nullif(F.regexp_extract(text, r":\s*(\d{1,9})\s*$", 1), F.lit("")), F.lit("999999999")).cast("int"), F.lit(0))


def source_files(text: Column, extension: str = ".cs") -> Column:
    """Distinct ``path.ext`` of the tokens that hold ``path.ext:``."""
    pattern = rf"(?i)^(.+{extension.replace('.', '[.]')}):"
    return F.array_distinct(F.filter(F.transform(F.split(text, " "), lambda t: F.regexp_extract(t, pattern, 1)), lambda t: t != ""))


def commit_sha(line: Column) -> Column:
    return F.substring_index(line, " ", 1)


def commit_subject(line: Column) -> Column:
    cut = F.instr(line, " ")
    return F.when(cut > 0, F.substr(line, cut + 1)).otherwise("")


def relative_file(path: Column, root: str) -> Column:
    """``path`` below ``root``, with forward slashes."""
    clean = F.translate(path, "\\", "/")
    base = root.replace("\\", "/").rstrip("/") + "/"
    return F.when(clean.startswith(base), F.substr(clean, F.lit(len(base) + 1))).otherwise(clean)


def package_name(key: Column) -> Column:
    """Package of an ``id/version`` key."""
    return F.substring_index(key, "/", 1)


def package_version(key: Column) -> Column:
    """Version of an ``id/version`` key as numbers, which order as versions."""
    return F.transform(F.split(F.regexp_replace(F.substring_index(key, "/", -1), "[-+].*$", ""), r"\."), lambda x: F.coalesce(x.try_cast("int"), F.lit(0)))


def generated_code(path: Column) -> Column:
    """Whether a file is generated model code."""
    return F.translate(path, "\\", "/").rlike(r"(?i)/Migrations/|\.Designer\.cs$|ModelSnapshot\.cs$")


def project_facts(path: Column, name: Column) -> dict[str, Column]:
    """module, layer and is_test of a project, from its path and name."""
    parts = F.split(F.translate(path, "\\", "/"), "/")
    low = F.transform(parts, lambda p: F.lower(p))
    at = F.array_position(low, F.lit("modules"))
    test = F.array_contains(low, F.lit("tests")) | F.array_contains(low, F.lit("test")) | name.rlike(r"(?i)[.]Tests?$")
    after = F.when(at > 0, F.try_element_at(parts, (at + 1).cast("int")))
    last = F.element_at(F.split(name, r"\."), -1)
    from_test = F.when(test, F.try_element_at(F.split(F.regexp_replace(name, r"(?i)[.]?(Unit|Integration|Architecture)?Tests?$", ""), r"\."), F.lit(-1)))
    shared = F.when(F.array_contains(low, F.lit("shared")), F.lit("Shared")).when(F.array_contains(low, F.lit("bootstrapper")), F.lit("Host"))
    return {"module": F.coalesce(after, shared, from_test, F.lit("unknown")), "layer": F.when(last.isin(*LAYERS), last), "is_test": test}


# --- stack traces: bracket depths need a loop, so these are Arrow-batched UDFs ----


FRAME = T.StructType(
    [
        *(T.StructField(n, T.StringType()) for n in ("type", "method", "key")),
        T.StructField("parameters", T.ArrayType(T.StringType())),
        T.StructField("file", T.StringType()),
        T.StructField("line", T.IntegerType()),
    ]
)


@F.pandas_udf(FRAME)
def parse_frame(lines: pd.Series) -> pd.DataFrame:
    """The frame of an ``at ...`` line; all null where it cannot be read."""
    rows = [frames.frame(x) if x is not None else None for x in lines]
    none = (None,) * 6
    return pd.DataFrame([r or none for r in rows], columns=["type", "method", "key", "parameters", "file", "line"]).astype({"line": "Int32"})


@F.pandas_udf(T.StringType())
def normal_type(types: pd.Series) -> pd.Series:
    """A type's short runtime name, for comparing spellings."""
    return types.map(lambda x: None if x is None else frames.normal_type(x))


@F.pandas_udf(T.ArrayType(T.StringType()))
def id_parameters(ids: pd.Series) -> pd.Series:
    """Normalised parameter types of a method id."""
    return ids.map(lambda x: None if x is None else [frames.normal_type(p) for p in frames.id_parameters(x)])


def is_separator(line: Column) -> Column:
    return F.trim(line).rlike(r"^-{3}.*-{3}$")


def is_frame(line: Column) -> Column:
    return F.trim(line).rlike(r"^at\s+.+$")


def header_type(line: Column) -> Column:
    """Exception type of a header line, or null if it is no header."""
    t = F.trim(line)
    kind = F.regexp_replace(F.when(F.instr(t, ": ") > 1, F.substring_index(t, ": ", 1)), r" \(0x.*$", "")
    return F.when(F.contains(kind, F.lit(".")) & ~kind.rlike(r"\s"), kind)


def header_message(line: Column) -> Column:
    t = F.trim(line)
    at = F.instr(t, ": ")
    return F.when(at > 0, F.substr(t, at + 2)).otherwise("")


# --- a link that holds a diagram ------------------------------------------------


def stored_zlib(data: bytes) -> bytes:
    """A zlib stream of stored blocks: the same bytes on every platform."""
    out = bytearray(b"\x78\x01")
    blocks = [data[i : i + 65535] for i in range(0, len(data), 65535)] or [b""]
    for i, b in enumerate(blocks):
        out += bytes([i == len(blocks) - 1]) + len(b).to_bytes(2, "little") + (len(b) ^ 0xFFFF).to_bytes(2, "little") + b
    return bytes(out + zlib.adler32(data).to_bytes(4, "big"))


def diagram_url(code: str, base: str = "https://mermaid.live/view#pako:") -> str:
    state = json.dumps({"code": code, "mermaid": {"theme": "default"}, "autoSync": True, "updateDiagram": True}, separators=(",", ":"), ensure_ascii=False)
    return base + base64.urlsafe_b64encode(stored_zlib(state.encode())).decode().rstrip("=")


@F.pandas_udf(T.StringType())
def diagram_link(code: pd.Series) -> pd.Series:
    return code.map(lambda c: None if c is None else diagram_url(c))
