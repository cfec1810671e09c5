"""Text-to-bytes decoding with built-in expressions only."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

HEX, BASE32, BASE64, RAW = "hex", "base32", "base64url", "raw"

# The base32 alphabet and the digits of Spark's base-32 conversion.
_BASE32_ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_BASE32_DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUV"


def to_base64url(data: Column) -> Column:
    """base64url text without padding or line breaks."""
    return F.translate(F.base64(data), "+/=\r\n", "-_")


def to_base32(data: Column) -> Column:
    """Base32 text without padding, five bytes (eight characters) at a time."""
    digits = F.hex(data)
    filled = F.concat(digits, F.repeat(F.lit("0"), F.pmod(-F.length(digits), F.lit(10)).cast("int")))
    blocks = F.regexp_extract_all(filled, F.lit(".{10}"), F.lit(0))
    text = F.array_join(F.transform(blocks, lambda block: F.lpad(F.conv(block, 16, 32), 8, "0")), "")
    used = F.ceil(F.octet_length(data) * 8 / F.lit(5)).cast("int")
    return F.translate(F.substring(text, F.lit(1), used), _BASE32_DIGITS, _BASE32_ALPHABET)


def _padding(length: Column, block: int) -> Column:
    return F.repeat(F.lit("="), F.pmod(-length, F.lit(block)).cast("int"))


def _strip_padding(text: Column) -> Column:
    return F.rtrim(text, F.lit("="))


def decode_base64(core: Column) -> Column:
    """Decode text of the standard alphabet without padding; NULL when the length rules it out."""
    length = F.length(core)
    padded = F.concat(core, _padding(length, 4))
    return F.when(length % 4 != 1, F.try_to_binary(padded, F.lit("base64")))


def decode_base64url(core: Column) -> Column:
    return decode_base64(F.translate(core, "-_", "+/"))


def decode_hex(text: Column) -> Column:
    return F.when(F.length(text) % 2 == 0, F.unhex(text))


def decode_base32(core: Column) -> Column:
    """Decode upper-case base32 without padding, eight characters (five bytes) at a time."""
    length = F.length(core)
    digits = F.translate(core, _BASE32_ALPHABET, _BASE32_DIGITS)
    filled = F.concat(digits, F.repeat(F.lit("0"), F.pmod(-length, F.lit(8)).cast("int")))
    blocks = F.regexp_extract_all(filled, F.lit(".{8}"), F.lit(0))
    as_hex = F.array_join(F.transform(blocks, lambda block: F.lpad(F.conv(block, 32, 16), 10, "0")), "")
    n_bytes = F.floor(length * 5 / 8).cast("int")
    return F.unhex(F.substring(as_hex, F.lit(1), n_bytes * 2))


def alphabet_flags(text: Column) -> dict[str, Column]:
    """What the characters of a text allow; a text in pieces allows what all its pieces allow."""
    return {
        "lower_hex": text.rlike("^[0-9a-f]*$"),
        "upper_hex": text.rlike("^[0-9A-F]*$"),
        "base32": text.rlike("^[A-Z2-7]*=*$"),
        "base64": text.rlike("^[A-Za-z0-9_+/-]*=*$"),
    }


def choose_alphabet(flags: dict[str, Column], length: Column) -> Column:
    """Name of the narrowest alphabet that fits; length counts the text without padding."""
    hex_only = flags["lower_hex"] | (flags["upper_hex"] & ~flags["base32"])
    return (
        F.when(hex_only & (length % 2 == 0), HEX)
        .when(flags["base32"] & (length % 8).isin(0, 2, 4, 5, 7), BASE32)
        .when(flags["base64"] & (length % 4 != 1), BASE64)
        .otherwise(RAW)
    )


def alphabet_of(text: Column) -> Column:
    return choose_alphabet(alphabet_flags(text), F.length(_strip_padding(text)))


def decode_as(text: Column, alphabet: Column) -> Column:
    """Decode a text, or an aligned piece of it, by the named alphabet."""
    core = _strip_padding(text)
    decoded = (
        F.when(alphabet == HEX, decode_hex(core))
        .when(alphabet == BASE32, decode_base32(core))
        .when(alphabet == BASE64, decode_base64url(core))
    )
    return F.coalesce(decoded, F.encode(text, "utf-8"))


def _lenient_base64(text: Column, added_pads: Column) -> Column:
    """Base64 that skips foreign characters and stops at the padding that completes a block of four."""
    clean = F.regexp_replace(text, "[^A-Za-z0-9+/=]", "")
    head = F.regexp_extract(clean, "^[^=]*", 0)
    tail = F.regexp_extract(clean, "^[^=]*(=*)", 1)
    spare = F.length(head) % 4
    ends_at_first_pad = (spare >= 2) & (F.length(tail) + spare >= 4)
    whole = F.translate(clean, "=", "")
    whole_spare = F.length(whole) % 4
    trailing = F.length(clean) - F.length(_strip_padding(clean)) + added_pads
    enough = (whole_spare == 0) | ((whole_spare >= 2) & (trailing + whole_spare >= 4))
    decoded = F.when(ends_at_first_pad, decode_base64(head)).when(enough, decode_base64(whole))
    # Text beyond ASCII is refused as a whole, not skipped. Most texts need no cleaning at all.
    return F.when(text.rlike("^[A-Za-z0-9+/]*$"), decode_base64(text)).when(
        ~text.rlike("[^\\x00-\\x7F]"), decoded
    )


def decode_cascade(text: Column) -> Column:
    """struct(payload, encoding): URL-safe base64, base64, base32, hex, then the text itself.

    Base64 comes first and is lenient, so base32 and hex text is mostly read as base64; decode_as with
    alphabet_of is the choice that round-trips. A text nothing decodes keeps the padding the earlier
    attempts added (up to a multiple of eight characters).
    """
    pads = F.pmod(-F.length(text), F.lit(4))
    padded4 = F.concat(text, _padding(F.length(text), 4))
    padded8 = F.concat(padded4, _padding(F.length(padded4), 8))
    url_safe = _lenient_base64(F.translate(text, "-_", "+/"), pads)
    standard = _lenient_base64(text, pads + 4)
    core32 = _strip_padding(padded8)
    pad_count = F.length(padded8) - F.length(core32)
    base32 = F.when(
        core32.rlike("^[A-Z2-7]*$") & pad_count.isin(0, 1, 3, 4, 6), decode_base32(core32)
    )
    hexadecimal = F.when(padded8.rlike("^[0-9A-Fa-f]+$"), decode_hex(padded8))
    # Going through a one-element array evaluates an attempt once for both its test and its result.
    attempt = lambda payload, name: F.get(F.transform(F.array(payload), lambda p: F.when(
        p.isNotNull(), F.struct(p.alias("payload"), F.lit(name).alias("encoding"))
    )), F.lit(0))
    return F.coalesce(
        attempt(url_safe, "base64url"), attempt(standard, "base64"), attempt(base32, "base32"),
        attempt(hexadecimal, "hex"), attempt(F.encode(padded8, "utf-8"), "raw"),
    )
