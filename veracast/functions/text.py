"""Text expressions over columns; everything but compatibility normalisation runs inside Spark's own functions."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..schema import MISSING, TWO_PART_SUFFIXES

#: Letters, numbers and underscore; combining marks are not part of words.
TOKEN = r"[\p{L}\p{N}_]+"
HASHTAG = r"(?<![\p{L}\p{N}_])#[\p{L}\p{N}_]+"
#: All white space: what the ends of a text are trimmed of.
WHITE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
_BLANK = "[" + WHITE + "]"
# runs of blanks within a line that are not just one space; line ends with spaces beside them
_ODD = WHITE.replace("\n", "").replace(" ", "")
# (the visible characters of ASCII, which are most, fail one test instead of one for each kind of blank)
_ACROSS = f"(?=[^!-~])(?:[{_ODD}][{_ODD} ]*| [{_ODD} ]+)"
_LINE_ENDS = " +\n *|\n +"
_AUTHORITY = r"^[^:/?#]+://(?:[^/?#]*@)?([^:/?#]*)"


def strip(x: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.trim(x, F.lit(WHITE))


def missing_to_null(x: Column) -> Column:
    """Trimmed; null for what stands for a missing value."""
    return present(strip(x.cast("string")))


def present(t: Column) -> Column:
    """A trimmed text, null where it stands for a missing value (none of which is longer than four characters)."""
    return F.when((F.length(t) > 4) | ~F.lower(t).isin(*MISSING), t)


def _stable() -> str:
    """Inside of a character class: letters beyond ASCII, marks of punctuation and ideographs that the compatibility form leaves alone,
    whatever stands beside them (none combines with what is before it)."""
    ranges, first = [], None
    for low, high in ((0xA1, 0x24F), (0x391, 0x3FF), (0x400, 0x482), (0x48A, 0x52F), (0x2010, 0x201F), (0x3041, 0x3096), (0x30A1, 0x30FA)):
        for c in range(low, high + 2):
            good = c <= high and unicodedata.category(chr(c)) != "Cn" and unicodedata.is_normalized("NFKC", chr(c))
            if good and first is None:
                first = c
            elif not good and first is not None:
                ranges.append((first, c - 1))
                first = None
    return r"\u4E00-\u9FA5" + "".join(f"\\u{a:04X}-\\u{b:04X}" for a, b in ranges)


# (one class of many ranges is slow for the characters of ASCII, which are most)
_UNSTABLE = rf"[^\x00-\x7F](?<![{_stable()}])"


def _nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def normalized(x: Column, nfkc: bool = True) -> Column:
    """Compatibility form, single spaces, no blanks around line ends or at the edges; null when nothing is left.

    Only texts with characters that the compatibility form may change go through Python: for others it is the text itself.
    """
    return F.nullif(spaced(missing_to_null(x), nfkc), F.lit(""))


def spaced(t: Column, nfkc: bool = True) -> Column:
    """``normalized`` for a text that is trimmed and not missing; empty when nothing is left."""
    t = F.when(t.contains("\r"), F.regexp_replace(t, "\r\n?", "\n")).otherwise(t)
    if nfkc:
        t = F.coalesce(F.pandas_udf(_nfkc, StringType())(F.when(t.rlike(_UNSTABLE), t)), t)
    t = F.regexp_replace(t, _ACROSS, " ")
    # most texts have no space beside a line end; the only element of an array is worked out once
    return strip(F.transform(F.array(t), lambda x: F.when(x.contains(" \n") | x.contains("\n "), F.regexp_replace(x, _LINE_ENDS, "\n")).otherwise(x))[0])


def keywords(x: Column) -> Column:
    """Comma-separated words with blanks collapsed, empty ones and later repeats dropped; null when none is left."""
    parts = F.transform(F.split(missing_to_null(x), ","), lambda p: strip(F.regexp_replace(p, rf"{_BLANK}+", " ")))
    joined = F.array_join(F.array_distinct(F.filter(parts, lambda p: p != "")), ", ")
    return F.when(joined != "", joined)


def keyword_count(clean: Column) -> Column:
    parts = F.filter(F.split(clean, ","), lambda p: strip(p) != "")
    return F.when(clean.isNotNull(), F.size(parts)).otherwise(0)


def text_statistics(x: Column) -> Column:
    """A struct of counts and ratios of tokens, hashtags and exclamation marks; all zero for null.

    Tokens are sorted, and the places where a token differs from the one before bound the runs of equal ones: their number and
    lengths give how many different tokens there are, the commonest and the number occurring three times.  What several fields are
    made of is the only element of an array, so that it stays one expression: of a plain struct each field would be worked out
    by itself, with all that it is made of.
    """
    text = F.coalesce(x, F.lit(""))
    tokens = F.transform(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)), lambda t: F.lower(t))

    def bounds(ordered: Column) -> Column:
        return F.filter(F.sequence(F.lit(0), F.size(ordered)), lambda i: ~F.get(ordered, i).eqNullSafe(F.get(ordered, i - 1)))

    def lengths(cuts: Column) -> Column:
        runs = F.transform(F.slice(cuts, 2, F.greatest(F.size(cuts), F.lit(0))), lambda end, i: end - F.get(cuts, i))
        return F.struct(runs.alias("runs"), F.coalesce(F.array_max(cuts), F.lit(0)).alias("n"))

    counted = F.transform(F.transform(F.array(F.sort_array(tokens)), bounds), lengths)[0]
    parts = F.struct(counted.alias("c"), F.regexp_count(text, F.lit(HASHTAG)).alias("tags"), exclamations(text).alias("loud"), F.length(text).alias("size"))
    return F.transform(
        F.array(parts),
        lambda p: F.struct(
            p["c"]["n"].alias("token_count"),
            F.size(p["c"]["runs"]).alias("unique_token_count"),
            F.coalesce(F.array_max(p["c"]["runs"]), F.lit(0)).alias("max_token_frequency"),
            (F.coalesce(F.array_max(p["c"]["runs"]), F.lit(0)) / F.greatest(p["c"]["n"], F.lit(1))).alias("max_token_ratio"),
            F.size(F.filter(p["c"]["runs"], lambda n: n >= 3)).alias("repeated_token_count_over_2"),
            p["tags"].alias("hashtag_count"),
            p["loud"].alias("exclamation_count"),
            (p["tags"] / F.greatest(p["size"], F.lit(1))).alias("hashtag_density_chars"),
            (p["tags"] / F.greatest(p["c"]["n"], F.lit(1))).alias("hashtag_density_tokens"),
        ),
    )[0]


def exclamations(x: Column) -> Column:
    return F.length(x) - F.length(F.replace(x, F.lit("!"), F.lit("")))


def semantic_input(x: Column) -> Column:
    """What a language model is given: no links, signs or digits, single spaces, lower case; empty for null."""
    t = F.regexp_replace(F.coalesce(x, F.lit("")), r"(?iU)http\S+|www\.\S+", " ")
    t = F.regexp_replace(t, "[@#]", "")
    t = F.regexp_replace(t, "[^\\p{L}\\p{N}_" + WHITE + "]", " ")
    t = F.regexp_replace(t, r"\p{Nd}+", " ")
    return F.lower(strip(F.regexp_replace(t, rf"{_BLANK}+", " ")))


def has_semantic_input(x: Column) -> Column:
    """Whether ``semantic_input`` leaves anything: a letter, sign of a number that is no digit, or underscore outside of links. Links are
    passed over as a whole, other characters one by one, and the first such character ends the search."""
    kept = r"\p{L}\p{Nl}\p{No}_"
    return F.coalesce(x, F.lit("")).rlike(rf"^(?:(?iU:http\S+|www\.\S+)|[^{kept}])*+[{kept}]")


def domain_parts(x: Column) -> Column:
    """A struct of a link's host, registered domain and subdomain; all null without a host. The scheme may be left out."""
    value = missing_to_null(x)
    link = F.when(value.contains("://"), value).otherwise(F.concat(F.lit("https://"), value))
    found = F.regexp_extract(link, _AUTHORITY, 1)
    host = F.regexp_replace(F.lower(F.when(found != "", found).otherwise(value)), r"^\.+|\.+$", "")
    # one-element arrays hold what several fields are made of, as in ``text_statistics``
    labelled = F.transform(F.array(host), lambda h: F.struct(F.nullif(h, F.lit("")).alias("host"), F.filter(F.split(h, r"\."), lambda p: p != "").alias("labels")))

    def fields(p: Column) -> Column:
        labels = p["labels"]
        n = F.size(labels)
        keep = F.when(F.array_join(F.slice(labels, -2, 2), ".").isin(*TWO_PART_SUFFIXES) & (n >= 3), 3).otherwise(2)
        rest = F.array_join(F.slice(labels, F.lit(1), F.greatest(n - keep, F.lit(0))), ".")
        return F.when(
            p["host"].isNotNull(),
            F.struct(
                p["host"].alias("raw_url_domain"),
                F.when(n < 2, p["host"]).otherwise(F.array_join(F.slice(labels, F.greatest(n - keep, F.lit(0)) + 1, keep), ".")).alias("registered_domain"),
                F.when((n >= 2) & (rest != ""), rest).alias("subdomain"),
            ),
        )

    return F.transform(labelled, fields)[0]


def text_hash(x: Column) -> Column:
    """SHA-1 of the text; all missing texts share one hash."""
    return F.sha1(F.coalesce(x, F.lit("<NA>")).cast("binary"))


def row_fingerprint(*columns: Column) -> Column:
    return F.xxhash64(F.concat_ws("\x1f", *[F.coalesce(c.cast("string"), F.lit("<NA>")) for c in columns]))


def time_bucket(x: Column, seconds: int) -> Column:
    """Number of the window of so many seconds since the epoch, rounded down before it too; null for no time."""
    return F.floor(F.unix_micros(x) / F.lit(float(seconds) * 1e6)).cast("long")


def to_instant(x: Column, kind: str) -> Column:
    """A time column as an instant in UTC (the session's zone); text that is no time is null."""
    return F.try_to_timestamp(x) if kind == "string" else x.cast("timestamp")
