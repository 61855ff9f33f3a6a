"""English stems in SQL, written from the stemmer's published rules with a table of suffixes.

Nothing here is taken from the code under test: rules are rows, and the longest
suffix of a word is picked by length.
"""

from __future__ import annotations

_RULES = """(values
  (2, 'tional', 'tion', 1), (2, 'enci', 'ence', 1), (2, 'anci', 'ance', 1), (2, 'abli', 'able', 1), (2, 'entli', 'ent', 1), (2, 'izer', 'ize', 1),
  (2, 'ization', 'ize', 1), (2, 'ational', 'ate', 1), (2, 'ation', 'ate', 1), (2, 'ator', 'ate', 1), (2, 'alism', 'al', 1), (2, 'aliti', 'al', 1),
  (2, 'alli', 'al', 1), (2, 'fulness', 'ful', 1), (2, 'ousli', 'ous', 1), (2, 'ousness', 'ous', 1), (2, 'iveness', 'ive', 1), (2, 'iviti', 'ive', 1),
  (2, 'biliti', 'ble', 1), (2, 'bli', 'ble', 1), (2, 'ogi', 'og', 1), (2, 'fulli', 'ful', 1), (2, 'lessli', 'less', 1), (2, 'li', '', 1),
  (3, 'tional', 'tion', 1), (3, 'ational', 'ate', 1), (3, 'alize', 'al', 1), (3, 'icate', 'ic', 1), (3, 'iciti', 'ic', 1), (3, 'ical', 'ic', 1),
  (3, 'ful', '', 1), (3, 'ness', '', 1), (3, 'ative', '', 2),
  (4, 'al', '', 2), (4, 'ance', '', 2), (4, 'ence', '', 2), (4, 'er', '', 2), (4, 'ic', '', 2), (4, 'able', '', 2), (4, 'ible', '', 2), (4, 'ant', '', 2),
  (4, 'ement', '', 2), (4, 'ment', '', 2), (4, 'ent', '', 2), (4, 'ism', '', 2), (4, 'ate', '', 2), (4, 'iti', '', 2), (4, 'ous', '', 2), (4, 'ive', '', 2),
  (4, 'ize', '', 2), (4, 'ion', '', 2)) as r(step, suffix, put, region)"""

STOPS = """string_split('i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself they them
 their theirs themselves what which who whom this that these those am is are was were be been being have has had having do does did doing a an the and but if
 or because as until while of at by for with about against between into through during before after above below to from up down in out on off over under again
 further then once here there when where why how all any both each few more most other some such no nor not only own same so than too very s t can will just
 don should now', ' ')"""
STOPS = " ".join(STOPS.split())


def _step(n: int, before: str) -> str:
    """One table step: the longest suffix that fits, then its conditions."""
    return f"""select term, r1, r2, alone, case when suffix is null then w
      when length(w) - length(suffix) < case region when 1 then r1 else r2 end then w
      when suffix = 'ogi' and not ends_with(left(w, length(w) - 3), 'l') then w
      when suffix = 'li' and not regexp_matches(left(w, length(w) - 2), '[cdeghkmnrt]$') then w
      when suffix = 'ion' and not regexp_matches(left(w, length(w) - 3), '[st]$') then w
      else left(w, length(w) - length(suffix)) || put end as w
    from (select b.term, any_value(b.w) w, any_value(b.r1) r1, any_value(b.r2) r2, any_value(b.alone) alone,
        arg_max(suffix, length(suffix)) suffix, arg_max(put, length(suffix)) put, arg_max(region, length(suffix)) region
      from {before} b left join (select * from {_RULES} where step = {n}) s on ends_with(b.w, s.suffix) group by b.term)"""


_SHORT = "regexp_matches({0}, '([^aeiouy][aeiouy][^aeiouywxY]|^[aeiouy][^aeiouy])$')"
_LEFT = "left(w, length(w) - {0})"

# from ``vocabulary`` (term) to ``stems`` (term, stem)
STEMS: dict[str, str] = {
    "stem0": r"""select term, w, r1, case when tail = '' then length(w) else r1 + length(tail) end as r2 from (
        select *, regexp_extract(substring(w, r1 + 1), '^.*?[aeiouy][^aeiouy]') as tail from (
          select term, w, case when regexp_matches(w, '^(gener|arsen)') then 5 when starts_with(w, 'commun') then 6
              when regexp_matches(w, '[aeiouy][^aeiouy]') then length(regexp_extract(w, '^.*?[aeiouy][^aeiouy]')) else length(w) end as r1
          from (select term, regexp_replace(regexp_replace(term, '^y', 'Y'), '([aeiouy])y', '\1Y', 'g') as w from vocabulary)))""",
    "stem1": f"""select *, w in ('inning', 'outing', 'canning', 'herring', 'earring', 'proceed', 'exceed', 'succeed') as alone from (
        select term, r1, r2, case when ends_with(w, 'sses') then {_LEFT.format(2)}
          when ends_with(w, 'ies') or ends_with(w, 'ied') then {_LEFT.format("(case when length(w) > 4 then 2 else 1 end)")}
          when ends_with(w, 'us') or ends_with(w, 'ss') or not ends_with(w, 's') then w
          when regexp_matches({_LEFT.format(2)}, '[aeiouy]') then {_LEFT.format(1)} else w end as w from stem0)""",
    "stem2": f"""select term, r1, r2, alone, w, cut, base, case when cut = 0 then w
          when ends_with(w, 'eed') or ends_with(w, 'eedly') then case when length(base) >= r1 then base || 'ee' else w end
          when not regexp_matches(base, '[aeiouy]') then w
          when ends_with(base, 'at') or ends_with(base, 'bl') or ends_with(base, 'iz') then base || 'e'
          when right(base, 2) in ('bb', 'dd', 'ff', 'gg', 'mm', 'nn', 'pp', 'rr', 'tt') then left(base, length(base) - 1)
          when {_SHORT.format("base")} and length(base) <= r1 then base || 'e' else base end as after
      from (select *, left(w, length(w) - cut) as base from (select *, case when alone then 0 when ends_with(w, 'eedly') or ends_with(w, 'ingly') then 5
          when ends_with(w, 'edly') then 4 when ends_with(w, 'eed') or ends_with(w, 'ing') then 3 when ends_with(w, 'ed') then 2 else 0 end as cut from stem1))""",
    "stem3": """select term, r1, r2, alone, case when not alone and lower(right(after, 1)) = 'y' and length(after) > 2
          and not contains('aeiouy', substring(after, length(after) - 1, 1)) then left(after, length(after) - 1) || 'i' else after end as w from stem2""",
    "stem4": _step(2, "stem3"),
    "stem5": _step(3, "stem4"),
    "stem6": _step(4, "stem5"),
    "stems": f"""select s.term, case when length(s.term) <= 2 then s.term else coalesce(x.stem, replace(case when s.alone then o.w
          when ends_with(s.w, 'e') and (length(s.w) - 1 >= s.r2 or (length(s.w) - 1 >= s.r1 and not {_SHORT.format("left(s.w, length(s.w) - 1)")})) then left(s.w, length(s.w) - 1)
          when ends_with(s.w, 'll') and length(s.w) - 1 >= s.r2 then left(s.w, length(s.w) - 1) else s.w end, 'Y', 'y')) end as stem
      from stem6 s join stem1 o using (term) left join (values ('skis', 'ski'), ('skies', 'sky'), ('dying', 'die'), ('lying', 'lie'), ('tying', 'tie'), ('idly', 'idl'),
        ('gently', 'gentl'), ('ugly', 'ugli'), ('early', 'earli'), ('only', 'onli'), ('singly', 'singl'), ('sky', 'sky'), ('news', 'news'), ('howe', 'howe'),
        ('atlas', 'atlas'), ('cosmos', 'cosmos'), ('bias', 'bias'), ('andes', 'andes')) as x(term, stem) on x.term = s.term""",
}
