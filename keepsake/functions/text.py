"""Scalar text rules as native column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from keepsake.schema import (
    DEFAULT_STATUS,
    GENERIC_TITLES,
    KIND_ALIASES,
    NAMED_ENTITIES,
    SECTION_SUBDOMAINS,
)

WHITESPACE = " \t\n\r\f\x0b"
HASHTAG = r"(^|\s)#([\p{L}\p{N}][\p{L}\p{N}/_-]*)"
URL = r"""(?i)https?://[^\s<>()"'\]]+"""


def literal_map(pairs: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it several times in one expression."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def strip(c: Column) -> Column:
    """Trim every ASCII whitespace character, not only blanks."""
    return F.btrim(c, F.lit(WHITESPACE))


def strip_to_null(c: Column) -> Column:
    return F.nullif(strip(c), F.lit(""))


def capitalise(c: Column) -> Column:
    return F.concat(F.upper(F.substring(c, 1, 1)), F.substring(c, 2, 2**31 - 1))


def iso(ts: Column) -> Column:
    """Timestamps leave the engine as ISO-8601 with microseconds, in UTC."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


def day(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd")


# -- kinds --------------------------------------------------------------------


def normalize_kind(kind: Column) -> Column:
    known = literal_map(KIND_ALIASES)
    word = F.lower(strip(kind))
    missing = kind.isNull() | (kind == "")
    return F.when(missing, "thought").otherwise(F.coalesce(F.try_element_at(known, word), word))


def default_status(kind: Column) -> Column:
    return F.try_element_at(literal_map(DEFAULT_STATUS), kind)


def status_or_default(status: Column, kind: Column) -> Column:
    return F.coalesce(strip_to_null(status), default_status(kind))


# -- titles, tags, hashtags -----------------------------------------------------


def derive_title(body: Column) -> Column:
    def cut(line: Column) -> Column:
        short = F.concat(F.regexp_replace(F.substring(line, 1, 87), r"\s+$", ""), F.lit("…"))
        return F.when(F.length(line) > 90, short).when(line != "", line)

    # the first line is cut out before it is trimmed, so long bodies are not copied
    return let(strip(F.split_part(F.ltrim(body, F.lit(WHITESPACE)), F.lit("\n"), F.lit(1))), cut)


def clean_tag(tag: Column) -> Column:
    t = F.regexp_replace(F.lower(strip(tag)), "^#", "")
    t = F.regexp_replace(t, r"\s*/\s*", "/")
    t = F.regexp_replace(t, "/{2,}", "/")
    return F.regexp_replace(t, "^/+|/+$", "")


def clean_tags(tags: Column) -> Column:
    """Shelf names in normal form, first occurrence kept."""
    cleaned = F.transform(F.coalesce(tags, F.array().cast("array<string>")), clean_tag)
    return F.array_distinct(F.filter(cleaned, lambda t: t.isNotNull() & (t != "")))


def hashtags(text: Column) -> Column:
    found = F.regexp_extract_all(text, F.lit(HASHTAG), F.lit(2))
    return F.coalesce(found, F.array().cast("array<string>"))


def without_hashtags(text: Column) -> Column:
    t = F.regexp_replace(text, HASHTAG, "$1")
    t = F.regexp_replace(t, r"[ \t]{2,}", " ")
    t = F.regexp_replace(t, r"(?m)\s+$", "")
    return let(strip(t), lambda x: F.when(x != "", x))


# -- links ------------------------------------------------------------------------


def extract_url(*texts: Column) -> Column:
    """First URL of the first text that holds one, closing punctuation dropped."""
    found = [let(F.regexp_extract(t, URL, 0), lambda x: F.when(x != "", x)) for t in texts]
    return F.regexp_replace(F.coalesce(*found), r"[.,;:!?]+$", "")


def is_url_only(text: Column) -> Column:
    return F.coalesce(strip(text).rlike(r"(?i)^https?://\S+$"), F.lit(False))


def is_weak_title(title: Column, tags: Column) -> Column:
    """Blank, a URL, or one bare word that is also a tag of the same item."""
    def weak(t: Column) -> Column:
        names_shelf = ~F.contains(t, F.lit(" ")) & F.exists(
            F.coalesce(tags, F.array().cast("array<string>")), lambda g: F.lower(g) == F.lower(t)
        )
        return t.isNull() | (F.length(t) < 3) | t.rlike("(?i)^https?://") | names_shelf

    return F.coalesce(let(strip(title), weak), F.lit(True))


def url_host(url: Column) -> Column:
    host = F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)
    return F.nullif(F.lower(host), F.lit(""))


def bare_domain(url: Column) -> Column:
    return F.regexp_replace(url_host(url), r"^www\.", "")


def title_from_url(url: Column) -> Column:
    path = F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]+([^?#]*)", 1)
    last = F.try_element_at(F.filter(F.split(path, "/"), lambda p: p != ""), F.lit(-1))
    t = F.regexp_replace(F.try_url_decode(last), r"(?i)\.(pdf|html?|php|aspx?|md|txt|docx?)$", "")
    t = strip(F.regexp_replace(F.regexp_replace(t, "[_+-]+", " "), r"\s+", " "))

    def usable(x: Column) -> Column:
        named = F.length(x).between(4, 120) & x.rlike("(?i)[a-z]{3}") & ~x.rlike("(?i)^[0-9a-f-]{16,}$")
        return F.when(named, capitalise(x))

    return let(t, usable)


def site_name(declared: Column, url: Column) -> Column:
    """The declared name unless it is just a hostname; else the domain's label."""
    named = declared.isNotNull() & (declared != "") & ~declared.rlike(r"(?i)^[a-z0-9.-]+\.[a-z]{2,}$")
    labels = F.filter(F.split(bare_domain(url), r"\."), lambda p: ~p.isin(SECTION_SUBDOMAINS))
    label = let(labels, lambda p: F.when(F.size(p) > 1, F.get(p, F.size(p) - 2)).otherwise(F.get(p, F.lit(0))))
    shown = let(label, lambda x: F.when(x != "", capitalise(x)))
    return F.when(named, declared).otherwise(F.coalesce(shown, declared))


def qualify_title(title: Column, site: Column, url: Column) -> Column:
    """Put the site in front of a title that says nothing on its own."""
    def qualified(x: Column) -> Column:
        t, name = x["t"], x["name"]
        vague = F.lower(t).isin(GENERIC_TITLES) | (F.length(t) < 8)
        redundant = name.isNull() | F.contains(F.lower(t), F.lower(name))
        return F.when(t == "", None).when(vague & ~redundant, F.concat(name, F.lit(" — "), t)).otherwise(t)

    return let(F.struct(strip(title).alias("t"), site_name(site, url).alias("name")), qualified)


def decode_entities(text: Column) -> Column:
    """One pass over entities, so an escaped entity is decoded once only."""
    named = literal_map(NAMED_ENTITIES)

    def code_point(n: Column) -> Column:
        valid = n.between(1, 0x10FFFF) & ~n.between(0xD800, 0xDFFF)
        wide = F.unhex(F.lpad(F.hex(n), 8, "0"))
        return F.when(valid, F.decode(wide, "UTF-32"))

    def one(piece: Column) -> Column:
        return F.when(piece.rlike("^&.+;$"), let(F.lower(F.substr(piece, F.lit(2), F.length(piece) - 2)), lambda k: entity(k, piece))).otherwise(piece)

    def entity(key: Column, piece: Column) -> Column:
        hex_n = F.conv(F.regexp_extract(key, "^#x([0-9a-f]{1,8})$", 1), 16, 10).cast("bigint")
        dec_n = F.nullif(F.regexp_extract(key, "^#([0-9]{1,9})$", 1), F.lit("")).cast("bigint")
        decoded = (
            F.when(key.rlike("^#x[0-9a-f]{1,8}$"), code_point(hex_n))
            .when(key.rlike("^#[0-9]{1,9}$"), code_point(dec_n))
            .otherwise(F.try_element_at(named, key))
        )
        return F.coalesce(decoded, piece)

    pieces = F.regexp_extract_all(text, F.lit(r"(?i)&(?:#x?[0-9a-f]+|[a-z]+);|[^&]+|&"), F.lit(0))
    plain = F.when(F.contains(text, F.lit("&")), F.array_join(F.transform(pieces, one), "")).otherwise(text)
    return strip(F.regexp_replace(plain, r"\s+", " "))


# -- words and trigrams --------------------------------------------------------------


def words(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def trigrams(text: Column) -> Column:
    """Distinct three-letter pieces of each word, two blanks before and one after."""

    def pieces(w: Column) -> Column:
        padded = F.concat(F.lit("  "), w, F.lit(" "))
        return F.transform(F.sequence(F.lit(1), F.length(w) + 1), lambda i: F.substr(padded, i, F.lit(3)))

    return F.array_distinct(F.flatten(F.transform(words(F.coalesce(text, F.lit(""))), pieces)))


def letter_pieces(text: Column) -> Column:
    """Every three letters in a row, lower-cased; shorter texts have none."""
    letters = F.split(F.lower(F.coalesce(text, F.lit(""))), "")

    def pieces(c: Column) -> Column:
        return F.transform(F.slice(c, F.lit(1), F.greatest(F.size(c) - 2, F.lit(0))), lambda a, i: F.concat(a, F.get(c, i + 1), F.get(c, i + 2)))

    return let(letters, pieces)


def needle_pieces(term: Column) -> Column:
    """Pieces that any text with the term in it must hold; none where wildcards leave no three letters in a row.

    An escape in a term makes its runs unsure, so it has none either.
    """
    runs = F.split(term, "[%_]")
    held = F.array_distinct(F.flatten(F.transform(runs, letter_pieces)))
    return F.when(F.contains(term, F.lit("\\")), F.array().cast("array<string>")).otherwise(held)


def jaccard(shared: Column, left: Column, right: Column) -> Column:
    """Set similarity from sizes, in single precision like the score it feeds."""
    return F.coalesce(F.try_divide(shared.cast("double"), left + right - shared), F.lit(0.0)).cast("float")


def set_similarity(a: Column, b: Column) -> Column:
    return jaccard(F.size(F.array_intersect(a, b)), F.size(a), F.size(b))


def trigram_similarity(a: Column, b: Column) -> Column:
    return let(F.struct(trigrams(a).alias("a"), trigrams(b).alias("b")), lambda s: set_similarity(s["a"], s["b"]))


def trigram_numbers(text: Column) -> Column:
    """The trigrams as hashes, for texts that are compared many times."""
    return F.transform(trigrams(text), lambda t: F.xxhash64(t))


def like_contains(text: Column, term: Column, lowered: Column | None = None) -> Column:
    """Case-insensitive substring test; ``%`` and ``_`` in the term stay wildcards.

    Most terms hold no wildcard, and a plain search needs no pattern compiled
    per row. ``lowered`` is the text in lower case, where a text meets many terms.
    """
    literal = F.regexp_replace(term, r"\\([^%_\\])", "$1")
    pattern = F.concat(F.lit("%"), literal, F.lit("%"))
    plain = F.contains(F.lower(text) if lowered is None else lowered, F.lower(term))
    return F.coalesce(F.when(term.rlike(r"[%_\\]"), F.ilike(text, pattern)).otherwise(plain), F.lit(False))
