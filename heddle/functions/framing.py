"""Byte-exact encodings, digests and identifiers as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def u64(number: Column) -> Column:
    """Eight bytes, most significant first."""
    return F.unhex(F.lpad(F.hex(number.cast("long")), 16, "0"))


def framed(text: Column) -> Column:
    """UTF-8 bytes behind their number."""
    return F.concat(u64(F.octet_length(text)), F.encode(text, "UTF-8"))


def framed_all(*texts: Column) -> Column:
    return F.concat(*(framed(t) for t in texts))


def sha256(*parts: Column) -> Column:
    """Lower-case hex digest of the parts' bytes."""
    return F.sha2(F.concat(*(p.cast("binary") for p in parts)), 256)


def hex_mod10(digest: Column) -> Column:
    """A hex number mod 10. Each power of 16 but the zeroth is 6 mod 10, so the digits before the last count six times."""
    digits = F.transform(F.split(digest, ""), lambda d: F.conv(d, 16, 10).cast("int"))
    total = F.aggregate(F.filter(digits, lambda d: d.isNotNull()), F.lit(0), lambda a, d: a + d)
    last = F.conv(F.substring(digest, -1, 1), 16, 10).cast("int")
    return (6 * (total - last) + last) % 10


def held_out(row_id: Column, residue: int = 9) -> Column:
    """Whether the digest of the id is `residue` mod 10."""
    return hex_mod10(F.sha2(row_id, 256)) == residue


def row_id(prefix: str, *parts: Column) -> Column:
    """prefix and the first half of the digest of the parts joined by NUL."""
    joined = reduce(lambda a, b: F.concat(a, F.lit("\x00"), b), parts)
    return F.concat(F.lit(prefix), F.substring(F.sha2(joined, 256), 1, 32))


def last_segment(fqn: Column) -> Column:
    """a.b.c -> %pkg.c; an empty name stays empty."""
    return F.when(fqn == "", "").otherwise(F.concat(F.lit("%pkg."), F.element_at(F.split(fqn, "\\."), -1)))


def request_fingerprint(commit: Column, env: Column, detectors: Column) -> Column:
    """Digest of a scan request; the order of its detectors doesn't count."""
    return F.sha2(F.concat_ws("\n", commit, env, F.array_join(F.sort_array(detectors), ",")), 256)


def content_id(commit: Column, rule: Column, uri: Column, line: Column, column: Column) -> Column:
    return F.sha2(F.concat_ws("|", commit, rule, uri, line.cast("string"), column.cast("string")), 256)


def retry_delay(attempt: Column, initial: float, most: float) -> Column:
    """Seconds to wait after the n-th attempt: doubling from `initial`, held at `most`."""
    return F.least(F.lit(float(most)), F.lit(float(initial)) * F.pow(F.lit(2.0), attempt - 1))


def truncated(text: Column, most: int) -> Column:
    """The longest beginning of at most `most` UTF-8 bytes that ends with a whole character."""
    raw = F.encode(text, "UTF-8")
    ends = [F.substring(raw, 1, most - k).cast("string") for k in range(min(4, most + 1))]
    return F.when(F.octet_length(text) <= most, text).otherwise(F.coalesce(*(F.when(F.is_valid_utf8(e), e) for e in ends), F.lit("")))
