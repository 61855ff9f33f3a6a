"""SQL spellings of the scalar text rules."""

from __future__ import annotations

from keepsake.plans.oracle_tables import WS
from keepsake.schema import GENERIC_TITLES, KIND_ALIASES, NAMED_ENTITIES, SECTION_SUBDOMAINS

HASHTAG = r"(^|\s)#([\p{L}\p{N}][\p{L}\p{N}/_-]*)"
URL = r"""(?i)https?://[^\s<>()"''\]]+"""


def strip(x: str) -> str:
    return f"trim({x}, {WS})"


def strip_null(x: str) -> str:
    return f"nullif({strip(x)}, '')"


def kind(x: str) -> str:
    k = f"lower({strip(x)})"
    arms = " ".join(f"when '{a}' then '{k_}'" for a, k_ in KIND_ALIASES.items())
    return f"case when {x} is null or {x} = '' then 'thought' else case {k} {arms} else {k} end end"


def default_status(k: str) -> str:
    return f"case {k} when 'movie' then 'want' when 'task' then 'open' when 'reading' then 'queued' end"


def title_of(body: str) -> str:
    line = strip(f"split_part({strip(body)}, chr(10), 1)")
    return (
        f"nullif(case when length({line}) > 90 then concat(regexp_replace(substring({line}, 1, 87), '\\s+$', ''), '…')"
        f" else {line} end, '')"
    )


def tag(t: str) -> str:
    x = f"regexp_replace(lower({strip(t)}), '^#', '')"
    x = rf"regexp_replace({x}, '\s*/\s*', '/', 'g')"
    x = f"regexp_replace({x}, '/{{2,}}', '/', 'g')"
    return f"regexp_replace({x}, '^/+|/+$', '', 'g')"


def tags_all(lst: str) -> str:
    return f"list_filter(list_transform({lst}, lambda t: {tag('t')}), lambda t: t <> '')"


def distinct(lst: str) -> str:
    return f"list_filter({lst}, lambda t, i: list_position({lst}, t) = i)"


def hashtags(x: str) -> str:
    return f"coalesce(regexp_extract_all({x}, '{HASHTAG}', 2), [])"


def untagged(x: str) -> str:
    t = rf"regexp_replace({x}, '{HASHTAG}', '\1', 'g')"
    t = rf"regexp_replace({t}, '[ \t]{{2,}}', ' ', 'g')"
    t = rf"regexp_replace({t}, '(?m)\s+$', '', 'g')"
    return strip_null(t)


def url(*xs: str) -> str:
    found = ", ".join(f"nullif(regexp_extract({x}, '{URL}', 0), '')" for x in xs)
    return f"regexp_replace(coalesce({found}), '[.,;:!?]+$', '')"


def url_only(x: str) -> str:
    return rf"coalesce(regexp_matches({strip(x)}, '(?i)^https?://\S+$'), false)"


def weak(title: str, tags: str) -> str:
    t = strip(title)
    return (
        f"coalesce({t} is null or length({t}) < 3 or regexp_matches({t}, '(?i)^https?://') or (not contains({t}, ' ')"
        f" and len(list_filter({tags}, lambda g: lower(g) = lower({t}))) > 0), true)"
    )


def cap(x: str) -> str:
    return f"concat(upper(substring({x}, 1, 1)), substring({x}, 2))"


def host(u: str) -> str:
    return f"nullif(lower(regexp_extract({u}, '^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1)), '')"


def domain(u: str) -> str:
    return rf"regexp_replace({host(u)}, '^www\.', '')"


def url_title(u: str) -> str:
    path = f"regexp_extract({u}, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]+([^?#]*)', 1)"
    last = f"list_filter(string_split({path}, '/'), lambda p: p <> '')[-1]"
    t = rf"regexp_replace(url_decode(replace({last}, '+', ' ')), '(?i)\.(pdf|html?|php|aspx?|md|txt|docx?)$', '')"
    t = strip(rf"regexp_replace(regexp_replace({t}, '[_+-]+', ' ', 'g'), '\s+', ' ', 'g')")
    return (
        f"case when length({t}) between 4 and 120 and regexp_matches({t}, '(?i)[a-z]{{3}}')"
        f" and not regexp_matches({t}, '(?i)^[0-9a-f-]{{16,}}$') then {cap(t)} end"
    )


def site(declared: str, u: str) -> str:
    skip = ", ".join(f"'{s}'" for s in SECTION_SUBDOMAINS)
    parts = f"list_filter(string_split({domain(u)}, '.'), lambda p: p not in ({skip}))"
    label = f"nullif(case when len({parts}) > 1 then {parts}[-2] else {parts}[1] end, '')"
    named = rf"{declared} is not null and {declared} <> '' and not regexp_matches({declared}, '(?i)^[a-z0-9.-]+\.[a-z]{{2,}}$')"
    return f"case when {named} then {declared} else coalesce({cap(label)}, {declared}) end"


def qualified(title: str, site_: str, u: str) -> str:
    generic = ", ".join(f"'{g}'" for g in GENERIC_TITLES)
    t, name = strip_null(title), site(site_, u)
    return (
        f"case when (lower({t}) in ({generic}) or length({t}) < 8) and not coalesce(contains(lower({t}), lower({name})), true)"
        f" then concat({name}, ' — ', {t}) else {t} end"
    )


def decoded(x: str) -> str:
    arms = " ".join(f"when '{k}' then '{v.replace(chr(39), chr(39) * 2)}'" for k, v in NAMED_ENTITIES.items())
    key = "lower(substring(p, 2, length(p) - 2))"
    piece = (
        f"case when not regexp_matches(p, '^&.+;$') then p "
        f"when regexp_matches({key}, '^#[0-9]{{1,7}}$') then chr(try_cast(substring({key}, 2) as integer)) "
        f"else coalesce(case {key} {arms} end, p) end"
    )
    pieces = f"regexp_extract_all({x}, '(?i)&(?:#x?[0-9a-f]+|[a-z]+);|[^&]+|&')"
    return strip(rf"regexp_replace(array_to_string(list_transform({pieces}, lambda p: {piece}), ''), '\s+', ' ', 'g')")
