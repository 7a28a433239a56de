"""SQL twin of the stemmer: one CTE per step over a relation of distinct words."""

from __future__ import annotations

from promptweir.functions import porter
from promptweir.registry.inputs import q


def _cases(rules: dict[str, str], test) -> tuple[str, str]:
    """CASE texts for the letters to drop and the text to add."""
    ordered = sorted(rules, key=lambda r: -len(r))
    drop = " ".join(f"WHEN ends_with(w, {q(s)}) THEN CASE WHEN {test(s)} THEN {len(s)} ELSE 0 END" for s in ordered)
    add = " ".join(f"WHEN ends_with(w, {q(s)}) THEN CASE WHEN {test(s)} THEN {q(rules[s])} ELSE '' END" for s in ordered)
    return f"CASE {drop} ELSE 0 END", f"CASE {add} ELSE '' END"


def _cv(n: int) -> str:
    return f"left(cv, length(w) - {n})"


def _m(n: int, above: int) -> str:
    return f"{_cv(n)} LIKE '{'%vc' * (above + 1)}%'"


def _cvc(n: int) -> str:
    return (f"(({_cv(n)} LIKE '%cvc' AND NOT regexp_matches(left(w, length(w) - {n}), '[wxy]$')) OR {_cv(n)} = 'vc')")


_STEPS = (
    ("CASE WHEN w LIKE '_ies' THEN 1 WHEN ends_with(w, 'sses') OR ends_with(w, 'ies') THEN 2 "
     "WHEN ends_with(w, 'ss') THEN 0 WHEN ends_with(w, 's') THEN 1 ELSE 0 END", "''", "false"),
    (f"""CASE WHEN ends_with(w, 'ied') THEN CASE WHEN length(w) = 4 THEN 1 ELSE 2 END
       WHEN ends_with(w, 'eed') THEN CASE WHEN {_m(3, 0)} THEN 1 ELSE 0 END
       WHEN ends_with(w, 'ed') AND contains({_cv(2)}, 'v') THEN 2
       WHEN ends_with(w, 'ing') AND contains({_cv(3)}, 'v') THEN 3 ELSE 0 END""", "''",
     f"""NOT ends_with(w, 'ied') AND NOT ends_with(w, 'eed') AND ((ends_with(w, 'ed') AND contains({_cv(2)}, 'v'))
       OR (ends_with(w, 'ing') AND contains({_cv(3)}, 'v')))"""),
    ("""CASE WHEN flag AND NOT regexp_matches(w, '(at|bl|iz)$') AND length(w) > 1 AND w[-1:] = w[-2:-2]
       AND cv[-1:] = 'c' AND NOT regexp_matches(w, '[lsz]$') THEN 1 ELSE 0 END""",
     f"""CASE WHEN flag AND (regexp_matches(w, '(at|bl|iz)$') OR (NOT (length(w) > 1 AND w[-1:] = w[-2:-2]
       AND cv[-1:] = 'c') AND {_m(0, 0)} AND NOT {_m(0, 1)} AND {_cvc(0)})) THEN 'e' ELSE '' END""", "false"),
    (f"CASE WHEN ends_with(w, 'y') AND length(w) > 2 AND ends_with({_cv(1)}, 'c') THEN 1 ELSE 0 END",
     f"CASE WHEN ends_with(w, 'y') AND length(w) > 2 AND ends_with({_cv(1)}, 'c') THEN 'i' ELSE '' END", "false"),
    (f"CASE WHEN ends_with(w, 'alli') AND {_m(4, 0)} THEN 2 ELSE 0 END", "''", "false"),
    (*_cases(porter.STEP2_RULES, lambda s: _m(3 if s == "logi" else len(s), 0)), "false"),
    (*_cases(porter.STEP3_RULES, lambda s: _m(len(s), 0)), "false"),
    (*_cases({s: "" for s in porter.STEP4_SUFFIXES}, lambda s: _m(len(s), 1) + (
        " AND regexp_matches(w, '[st]ion$')" if s == "ion" else "")), "false"),
    (f"CASE WHEN ends_with(w, 'e') AND ({_m(1, 1)} OR ({_m(1, 0)} AND NOT {_cvc(1)})) THEN 1 ELSE 0 END", "''", "false"),
    (f"CASE WHEN ends_with(w, 'll') AND {_m(1, 1)} THEN 1 ELSE 0 END", "''", "false"),
)


def stems_sql(words: str, out: str = "stem_of") -> str:
    """CTEs that turn relation ``words(word)`` into ``out(word, stem)``."""
    spell = """list_reduce(string_split(word, ''), lambda acc, ch: acc || CASE WHEN contains('aeiou', ch) THEN 'v'
      WHEN ch = 'y' AND ends_with(acc, 'c') THEN 'v' ELSE 'c' END, '')"""
    ctes = [f"{out}_0 AS (SELECT word, word AS w, {spell} AS cv, false AS flag FROM {words})"]
    for i, (drop, add, flag) in enumerate(_STEPS, 1):
        ctes.append(f"""{out}_e{i} AS (SELECT *, {drop} AS n, {add} AS a, {flag} AS f FROM {out}_{i - 1})""")
        ctes.append(f"""{out}_{i} AS (
  SELECT word, left(w, length(w) - n) || a AS w,
    left(cv, length(w) - n) || regexp_replace(regexp_replace(a, '[^aeiou]', 'c', 'g'), '[aeiou]', 'v', 'g') AS cv, f AS flag
  FROM {out}_e{i})""")
    irregular = " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in porter.IRREGULAR.items())
    ctes.append(f"""{out} AS (
  SELECT word, CASE word {irregular} ELSE CASE WHEN length(word) <= 2 THEN word ELSE w END END AS stem
  FROM {out}_{len(_STEPS)})""")
    return ",\n".join(ctes)
