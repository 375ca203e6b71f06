"""Column functions: text, vectors, hashes, images."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def tokens(text) -> Column:
    """Lower-cased runs of a-z and 0-9."""
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))


def normalised_title(text) -> Column:
    return F.array_join(tokens(text), " ")


def stripped(text) -> Column:
    """Without any white space at either end."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def shortened(text, width: int = 180) -> Column:
    """White space collapsed; cut to width with an ellipsis."""
    flat = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(F.length(flat) > width, F.concat(F.rtrim(F.substring(flat, 1, width - 1)), F.lit("…"))).otherwise(flat)


def jaccard(a, b) -> Column:
    """Of two arrays as sets; 0 where both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a, b) -> Column:
    """0 where either vector is zero."""
    size = norm(a) * norm(b)
    return F.when(size == 0, F.lit(0.0)).otherwise(dot(a, b) / size)


def bound(value, f) -> Column:
    """f of a value that is computed once a row, however often f and its inner lambdas read it."""
    return F.transform(F.array(value), f)[0]


def centred(a) -> Column:
    """Mean removed, then unit length (zero vectors stay)."""
    # each step is bound: as plain columns, mean and length would be computed anew for every element of every step
    mean = F.try_divide(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double")), F.size(a))
    unit = lambda off: bound(norm(off), lambda z: F.transform(off, lambda x: F.when(z == 0, F.lit(0.0)).otherwise(x / z)))
    return bound(mean, lambda m: bound(F.transform(a, lambda x: x.cast("double") - m), unit))


def shuffle_key(seed: int, user, item) -> Column:
    """A reproducible random order of items for each user."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), user.cast("string"), item.cast("string")).cast("binary"))


def first_hash_byte(text) -> Column:
    return F.conv(F.substring(F.sha2(text.cast("binary"), 256), 1, 2), 16, 10).cast("int")


def hex_bits(text) -> Column:
    """Sixteen hex digits as a signed 64-bit number."""
    return F.conv(text, 16, -10).cast("long")


def sign_bits(vector, n: int = 64) -> Column:
    """The first n signs of a vector as bits, most significant first."""
    pairs = F.slice(vector, 1, n)
    return F.aggregate(pairs, F.lit(0).cast("long"), lambda s, x: F.shiftleft(s, 1).bitwiseOR(F.when(x > 0, F.lit(1).cast("long")).otherwise(F.lit(0).cast("long"))))


def hamming(a, b) -> Column:
    return F.bit_count(a.bitwiseXOR(b)).cast("int")


def history_bucket(n) -> Column:
    return F.when(n <= 3, "1-3").when(n <= 6, "4-6").when(n <= 10, "7-10").otherwise("11+")


def policy(n) -> Column:
    return F.when(n >= 4, "standard").otherwise("caution")


def xml_escaped(text) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text


def has_non_ascii(text) -> Column:
    return text.rlike(r"[^\x00-\x7F]")


def iso_utc(ms) -> Column:
    """ISO 8601 in UTC, whatever the session's time zone."""
    at = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(secs=ms.cast("decimal(18,0)") / F.lit(1000).cast("decimal(18,0)"))
    return F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def percent(value, digits: int = 1) -> Column:
    """A share as a percentage with a fixed number of decimals."""
    return F.format_string(f"%.{digits}f%%", value * 100)


def fixed(value, digits: int) -> Column:
    return F.format_string(f"%.{digits}f", value)


def luma(r, g, b) -> Column:
    return r * 299 + g * 587 + b * 114


def difference_hash(rows) -> Column:
    """Upper-case hex of strict left > right over rows of luma values, the leftmost bit first."""
    bits = F.flatten(F.transform(rows, lambda row: F.zip_with(F.slice(row, 1, F.size(row) - 1), F.slice(row, 2, F.size(row) - 1), lambda x, y: F.when(x > y, "1").otherwise("0"))))
    return F.lpad(F.upper(F.conv(F.array_join(bits, ""), 2, 16)), 16, "0")
