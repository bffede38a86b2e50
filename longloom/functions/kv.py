"""Query-string parsing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _decode(piece: Column) -> Column:
    """Percent-decoded text; a percent sign that starts no escape stands for itself."""
    stray = "%(?![0-9A-Fa-f]{2})"
    escaped = F.when(piece.rlike(stray), F.regexp_replace(piece, stray, "%25")).otherwise(piece)
    coded = piece.contains("%") | piece.contains("+")
    return F.when(coded, F.try_url_decode(escaped)).otherwise(piece)


def query_param(text: Column, key: str) -> Column:
    """Value of one key of an ``a=1&b=2`` string, percent-decoded.

    Blank values do not count, the last of several values wins, an absent key gives NULL. Usually one pattern finds
    the value and only that is decoded. Text with escapes in the name of some part is taken apart in full, since the
    key itself may be written that way.
    """
    found = F.regexp_extract(text, rf"(?s)^(?:.*&)?\Q{key}\E=([^&]+)", 1)
    # through a lambda, so that the pattern runs once and not once per mention of its result
    plain = F.get(F.transform(F.array(found), lambda v: F.when(v != "", _decode(v))), F.lit(0))

    def decoded(part: Column) -> Column:
        at = F.locate("=", part)
        name = F.when(at > 0, F.substring_index(part, "=", 1))
        return F.struct(_decode(name).alias("k"), _decode(part.substr(at + 1, F.length(part))).alias("v"))

    pairs = F.transform(F.split(text, "&"), decoded)
    hits = F.filter(pairs, lambda p: (p["k"] == F.lit(key)) & (F.length(p["v"]) > 0))
    coded_name = (text.contains("%") | text.contains("+")) & text.rlike("(?:^|&)[^=&]*[%+][^=&]*=")
    return F.when(coded_name, F.try_element_at(hits, F.lit(-1))["v"]).otherwise(plain)


def truthy(text: Column) -> Column:
    """Neither NULL nor empty."""
    return text.isNotNull() & (F.length(text) > 0)
