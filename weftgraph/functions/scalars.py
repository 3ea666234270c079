"""Scalar functions over identities, ids, tags, text and digests."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WHITESPACE = r"[\t\n\x0B\f\r ]"
CONTROL = r"[\x00-\x1F\x7F]"
#: Segments and tags may not hold these, nor white space or control characters (fixed values).
RESERVED = ".,#\"'`{}<>"


def whitespace_only(text: Column) -> Column:
    return text.rlike(rf"\A{WHITESPACE}*\z")


def utf8_length(text: Column) -> Column:
    return F.octet_length(text)


def byte_set(values: Column) -> Column:
    """Distinct values in byte order."""
    return F.array_sort(F.array_distinct(values))


def split_tags(value: Column) -> Column:
    return byte_set(F.filter(F.split(value, WHITESPACE + "+"), lambda x: x != ""))


def split_lines(text: Column) -> Column:
    """Lines with their terminators: CRLF, LF or CR; the last may lack one."""
    return F.regexp_extract_all(text, F.lit(r"[^\r\n]*(?:\r\n|\n|\r)|[^\r\n]+$"), F.lit(0))


def identity_path(identity: Column) -> Column:
    return F.substring_index(identity, "#", 1)


def identity_id(identity: Column) -> Column:
    return F.when(F.contains(identity, F.lit("#")), F.element_at(F.split(identity, "#", 2), 2))


def parent_id(id: Column) -> Column:
    """An id without its last segment; null for a single one."""
    return F.when(F.contains(id, F.lit(".")), F.regexp_replace(id, r"\.[^.]*$", ""))


def replace_id_prefix(id: Column, old: str, new: str) -> Column:
    """On a segment's boundary; null where ``old`` is no prefix."""
    return F.when(id == old, F.lit(new)).when(F.startswith(id, F.lit(old + ".")), F.concat(F.lit(new), F.substr(id, F.lit(len(old) + 1))))


def id_problem(id: Column) -> Column:
    """First rule that an id's segments break, null if none."""
    return (
        F.when(id.isNull() | (id == ""), "empty")
        .when(F.exists(F.split(id, r"\."), lambda s: s == ""), "empty segment")
        .when(id.rlike(CONTROL), "control character")
        .when(id.rlike(WHITESPACE), "white space")
        .when(id.rlike(r"[#\"'`{}<>,]"), "reserved character")
    )


def spelling_problem(identity: Column) -> Column:
    """First rule that the spelling of a node's identity breaks, null if none."""
    path, id = identity_path(identity), identity_id(identity)
    return F.when(path == "", "empty path").when(path.rlike(CONTROL), "control character in the path").when(id.isNotNull(), id_problem(id))


def frame(part: Column) -> Column:
    """Eight bytes of length, most significant first, then the bytes."""
    raw = part.cast("binary")
    return F.concat(F.unhex(F.lpad(F.hex(F.octet_length(raw)), 16, "0")), raw)


def digest(*parts: Column) -> Column:
    """SHA-256 of framed components."""
    return F.sha2(F.concat(*[frame(p) for p in parts]), 256)


def frame_all(values: Column) -> Column:
    """Framed components of an array, as one binary."""
    return joined(F.transform(values, frame))


def joined(values: Column) -> Column:
    """Binaries of an array as one; by their hexadecimal digits, so that the time follows the length."""
    return F.unhex(F.array_join(F.transform(values, F.hex), ""))


def digest_all(values: Column) -> Column:
    return F.sha2(frame_all(values), 256)


def encode_canonical(identity: Column, position: Column) -> Column:
    return F.concat_ws(":", position.cast("string"), identity)


def parse_canonical(text: Column) -> Column:
    """(position, identity) of an encoded canonical identity; null unless it begins with a plain decimal and a colon."""
    number = F.regexp_extract(text, r"\A(0|[1-9][0-9]*):", 1)
    return F.when(number != "", F.struct(number.cast("long").alias("position"), F.substr(text, F.length(number) + 2).alias("identity")))


def byte_offset(text: Column, index: Column) -> Column:
    """Bytes of UTF-8 before a UTF-16 index of a text; one inside a pair of surrogates counts as the pair's first."""
    units = F.encode(text, "UTF-16BE")
    high = lambda at: F.conv(F.hex(F.substring(units, at, F.lit(2))), 16, 10).cast("int")
    inside = (index > 0) & high((2 * index - 1).cast("int")).between(0xD800, 0xDBFF)
    until = F.when(inside, index - 1).otherwise(index)
    return F.octet_length(F.decode(F.substring(units, F.lit(1), (2 * until).cast("int")), "UTF-16BE"))


def utf16_index(text: Column, offset: Column) -> Column:
    """UTF-16 index of a byte offset that begins a character of a text."""
    return (F.octet_length(F.encode(F.decode(F.substring(text.cast("binary"), F.lit(1), offset.cast("int")), "UTF-8"), "UTF-16BE")) / 2).cast("int")


def path_key(path: Column) -> Column:
    """The bytes of a path as lower-case hexadecimal: a key in byte order."""
    return F.lower(F.hex(path.cast("binary")))


def json_string(text: Column) -> Column:
    return F.substring(F.to_json(F.array(text)), F.lit(2), F.length(F.to_json(F.array(text))) - 2)


def path_json(path: Column) -> Column:
    """A path of bytes as JSON: a string where it is valid UTF-8, else its bytes marked as such."""
    raw = path.cast("binary")
    return F.when(F.is_valid_utf8(raw.cast("string")), json_string(raw.cast("string"))).otherwise(F.concat(F.lit('{"bytes":"'), path_key(path), F.lit('"}')))


def canonical_json(**values: Column) -> Column:
    """An object as JSON without spaces, its keys in byte order; absent values are null."""
    parts = [F.concat(F.lit(f'"{k}":'), F.coalesce(values[k], F.lit("null"))) for k in sorted(values, key=str.encode)]
    return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))


def json_valid(text: Column) -> Column:
    return F.try_parse_json(text).isNotNull()


#: Codes of findings in their order: the numbered conditions, then the reasons of refusals (fixed values).
CODES = (
    "missing-id", "invalid-structural-id", "duplicate-id", "invalid-segment-or-tag", "unknown-dependency", "unknown-text-target", "unknown-ts-reference", "invalid-argument", "cycle", "stale-output", "cross-module-text",
    "policy-violation", "journal-error", "configuration-error", "invalid-import", "invalid-construct", "invalid-prop", "unsupported-node-usage", "invalid-source-path", "unparseable-source", "corrupt-session",
    "obstructed-write-path", "unreadable-record", "write-failure", "read-failure", "workspace-busy",
    "refused-invalid-id", "refused-identity-unchanged", "refused-id-collision", "refused-structural-parent", "refused-cycle", "refused-destination-exists", "refused-missing-target-parent", "refused-invalid-destination",
    "refused-exposed-derived-file", "refused-invalid-rewrite", "refused-moved-import",
)
#: Codes that end a command as wrongly used (fixed values).
USAGE = ("configuration-error", "write-failure", "read-failure", "workspace-busy")


def code_ordinal(code: Column) -> Column:
    """Rank of a finding's code from 0; a finding without one comes last."""
    return F.coalesce(F.array_position(F.array(*map(F.lit, CODES)), code) - 1, F.lit(len(CODES))).cast("int")


def exit_class(code: Column) -> Column:
    return F.when(code.isin(*USAGE), 2).otherwise(1)


def doc_comment(text: Column, limit: int = 1000) -> Column:
    """Text cut to ``limit`` code points, with an ellipsis if cut, safe inside a block comment."""
    cut = F.concat(F.substring(text, 1, limit), F.when(F.length(text) > limit, F.lit("…")).otherwise(F.lit("")))
    return F.replace(cut, F.lit("*/"), F.lit("*\\/"))


def resolve_specifier(importer: Column, specifier: Column) -> Column:
    """Path of a ``./`` or ``../`` import, from the importer's folder; null above the root or for other forms."""
    folder = F.split(F.regexp_replace(importer, r"[^/]*$", ""), "/")
    steps = F.filter(F.concat(folder, F.split(specifier, "/")), lambda s: (s != "") & (s != "."))
    start = F.struct(F.array().cast("array<string>").alias("path"), F.lit(True).alias("inside"))
    up = lambda s: F.struct(F.slice(s["path"], F.lit(1), F.greatest(F.size(s["path"]) - 1, F.lit(0))).alias("path"), (s["inside"] & (F.size(s["path"]) > 0)).alias("inside"))
    down = lambda s, x: F.struct(F.concat(s["path"], F.array(x)).alias("path"), s["inside"].alias("inside"))
    done = F.aggregate(steps, start, lambda s, x: F.when(x == "..", up(s)).otherwise(down(s, x)))
    return F.when(specifier.rlike(r"^\.\.?/") & done["inside"] & (F.size(done["path"]) > 0), F.array_join(done["path"], "/"))
