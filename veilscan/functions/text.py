"""Page text: readability, normalised words, fingerprints, digests, body formats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from veilscan.constants import MIN_TEXT_CHARS, SHINGLE_WORDS, WINNOW_WINDOW
from veilscan.functions.core import let, strip

# Three runs of three or more ASCII letters with a vowel in each; stops at the third.
THREE_WORDS = r"(?s)(?:(?<![A-Za-z])(?=[A-Za-z]{3})[b-df-hj-np-tv-zB-DF-HJ-NP-TV-Z]*[AEIOUaeiou].*?){3}"
LETTER_SHARE = 0.30
WORD = r"[\p{L}\p{N}_]+"
GAP = r"[^\p{L}\p{N}_]"
# 63-bit, non-negative.
HASH_MASK = (1 << 63) - 1


def is_blank(text: Column) -> Column:
    return strip(text) == ""


def looks_like_language(text: Column) -> Column:
    """Real words, or at least enough letters; a blank text is neither."""
    return let(
        strip(text),
        lambda s: (s != "")
        & (
            F.rlike(s, F.lit(THREE_WORDS))
            | (F.regexp_count(s, F.lit(r"\p{L}")) / F.length(s).cast("double") >= F.lit(LETTER_SHARE))
        ),
    )


def is_thin(text: Column, minimum: int = MIN_TEXT_CHARS) -> Column:
    """Too little text, or text that is not language: a page for the deferred tier."""
    return (F.length(strip(text)) < minimum) | ~looks_like_language(text)


def is_misencoded(text: Column, minimum: int = MIN_TEXT_CHARS) -> Column:
    """Enough characters, yet not language."""
    return (F.length(strip(text)) >= minimum) & ~looks_like_language(text)


def words(text: Column) -> Column:
    """Lower-cased words; punctuation and white space separate them."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def has_words(text: Column) -> Column:
    """True exactly when a text has a fingerprint; cheap, as it stops at the first word."""
    return F.rlike(text, F.lit(WORD))


def first_words(text: Column, count: int) -> Column:
    """The first ``count`` words; the text is read no further than they reach."""
    opening = rf"(?s)\A{GAP}*+(?:{WORD}+{GAP}++){{0,{count - 1}}}(?:{WORD}+)?"
    return words(F.regexp_extract(text, opening, 0))


def has_at_least(text: Column, count: int) -> Column:
    """Whether a text has ``count`` words; stops at the last of them."""
    return F.rlike(text, F.lit(rf"(?:{WORD}+{GAP}++){{{count - 1}}}{WORD}"))


def md5_63(value: Column) -> Column:
    """First 60 bits of the MD5 digest as a non-negative long; any SQL engine can repeat it."""
    return F.conv(F.substring(F.md5(value), 1, 15), 16, 10).cast("bigint")


def xx_63(value: Column) -> Column:
    """Faster 63-bit hash for corpora that no other engine has to read."""
    return F.xxhash64(value).bitwiseAND(F.lit(HASH_MASK))


HASHES = {"md5": md5_63, "xxhash64": xx_63}


def shingle_hashes(text: Column, k: int = SHINGLE_WORDS, hashing: str = "md5") -> Column:
    """Hash of every run of ``k`` words; a shorter text has one shingle, an empty one none."""
    return let(words(text), lambda ws: word_shingles(ws, k, hashing))


def word_shingles(ws: Column, k: int = SHINGLE_WORDS, hashing: str = "md5") -> Column:
    """The same of an array of words, which is used several times."""
    hashed = HASHES[hashing]

    def rolled(ws: Column) -> Column:
        last = F.greatest(F.size(ws) - k, F.lit(0))
        return F.when(
            F.size(ws) > 0,
            F.transform(
                F.sequence(F.lit(1), last + 1),
                lambda at: hashed(F.array_join(F.slice(ws, at, F.lit(k)), " ")),
            ),
        ).otherwise(F.array().cast("array<bigint>"))

    return rolled(ws)


def paired_with(hop: int):
    """Array step that takes the lower of each element and the one ``hop`` places on."""

    def step(cur: Column) -> Column:
        ahead = F.slice(cur, F.lit(hop + 1), F.greatest(F.size(cur) - hop, F.lit(0)))
        return F.zip_with(cur, ahead, lambda a, b: F.least(a, b))

    return step


def winnow(hashes: Column, window: int = WINNOW_WINDOW) -> Column:
    """Set of the minima of every ``window`` neighbouring hashes; of all hashes when there
    are no more than ``window``."""

    def minima(hs: Column) -> Column:
        # Doubling: after each step an element is the minimum of the next ``span`` hashes.
        out, span = hs, 1
        while span < window:
            hop = min(span, window - span)
            out, span = let(out, paired_with(hop)), span + hop
        return F.slice(out, F.lit(1), F.greatest(F.size(hs) - window + 1, F.lit(1)))

    return let(
        hashes,
        lambda hs: F.when(F.size(hs) > 0, F.array_distinct(minima(hs))).otherwise(hs),
    )


def fingerprint(text: Column, k: int = SHINGLE_WORDS, window: int = WINNOW_WINDOW, hashing: str = "md5") -> Column:
    return winnow(shingle_hashes(text, k, hashing), window)


def digest(body: Column) -> Column:
    return F.sha2(body, 256)


def sniff_format(body: Column) -> Column:
    """Format of a binary body from all of it: leading marks first, then a page mark anywhere,
    then whether it is text (valid UTF-8 without NUL)."""

    def kind(h: Column) -> Column:
        def starts(hex_text: str) -> Column:
            return F.startswith(F.hex(F.substring(h, 1, len(hex_text) // 2)), F.lit(hex_text))

        def holds(raw: bytes) -> Column:
            return F.contains(h, F.lit(raw))

        return (
            F.when(starts(b"%PDF".hex().upper()), F.lit("pdf"))
            .when(starts(b"%!PS".hex().upper()), F.lit("postscript"))
            .when(starts(b"\x1b%-12345X".hex().upper()) | starts(b"\x1bE".hex().upper()), F.lit("pcl"))
            .when(holds(b"%PDF"), F.lit("pdf"))
            .when(holds(b"\x00"), F.lit("binary"))
            .when(~F.is_valid_utf8(h.cast("string")), F.lit("binary"))
            .otherwise(F.lit("text"))
        )

    return let(body, kind)


def magic(body: Column, length: int = 16) -> Column:
    """First bytes of a body for an audit line: hex pairs, then printable ASCII or dots."""

    def line(h: Column) -> Column:
        pairs = F.regexp_extract_all(F.lower(F.hex(h)), F.lit("..")  , F.lit(0))
        shown = F.array_join(
            F.transform(
                pairs,
                lambda p: let(
                    F.conv(p, 16, 10).cast("int"),
                    lambda code: F.when(code.between(32, 126), F.chr(code.cast("bigint"))).otherwise(F.lit(".")),
                ),
            ),
            "",
        )
        return F.when(F.length(h) > 0, F.concat(F.lit(" first bytes: "), F.array_join(pairs, " "), F.lit(" |"), shown, F.lit("|"))).otherwise(F.lit(""))

    return let(F.substring(body, 1, length), line)
