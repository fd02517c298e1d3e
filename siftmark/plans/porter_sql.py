"""English (Porter2) stems in DuckDB, written from the published algorithm.

For the statements that check stemmed results; the engine does not use it.
"""

from __future__ import annotations

# Fixed values of the published algorithm: whole words, endings and what they become.
_WHOLE = (
    "andes andes atlas atlas bias bias cosmos cosmos dying die early earli gently gentl howe howe "
    "idly idl lying lie news news only onli singly singl skies sky skis ski sky sky tying tie "
    "ugly ugli"
).split()
_UNCHANGED_AFTER_1A = "canning earring exceed herring inning outing proceed succeed".split()
_SECOND = (
    "abli able aliti al alism al alli al anci ance ation ate ational ate ator ate biliti ble "
    "bli ble enci ence entli ent fulli ful fulness ful iveness ive iviti ive ization ize izer ize "
    "lessli less ousli ous ousness ous tional tion"
).split()
_THIRD = "alize al ational ate icate ic ical ic iciti ic tional tion".split()
_THIRD_DROPPED = "ful ness".split()
_FOURTH = "able al ance ant ate ement ence ent er ible ic ism iti ive ize ment ous".split()

_V, _N = "[aeiouy]", "[^aeiouy]"
_SHORT = f"({_N}{_V}[^aeiouywxY]|^{_V}{_N})$"
_REGION = f"^{_N}*{_V}+{_N}"


def _list(words: list[str]) -> str:
    return ", ".join(f"'{w}'" for w in words)


def _endings(rules: dict[str, str]) -> str:
    """CASE over endings, longest first; each value is an expression for the new word."""
    order = sorted(rules, key=lambda e: (-len(e), e))
    whens = " ".join(f"WHEN ends_with(w, '{e}') THEN {rules[e]}" for e in order)
    return f"CASE {whens} ELSE w END"


def _cut(ending: str, new: str, region: str, more: str = "true") -> str:
    """Replace an ending that lies in a region."""
    n = len(ending)
    return (
        f"CASE WHEN length(w) - {n} >= {region} AND {more}"
        f" THEN left(w, length(w) - {n}) || '{new}' ELSE w END"
    )


def _drop_participle(ending: str) -> str:
    head = f"left(w, length(w) - {len(ending)})"
    return f"""CASE WHEN NOT regexp_matches({head}, '{_V}') THEN w
      WHEN regexp_matches({head}, '(at|bl|iz)$') THEN {head} || 'e'
      WHEN regexp_matches({head}, '(bb|dd|ff|gg|mm|nn|pp|rr|tt)$') THEN left({head}, length({head}) - 1)
      WHEN length({head}) <= r1 AND regexp_matches({head}, '{_SHORT}') THEN {head} || 'e'
      ELSE {head} END"""


def _steps() -> list[str]:
    plural = _endings(
        {
            "sses": "left(w, length(w) - 2)",
            "ied": "CASE WHEN length(w) > 4 THEN left(w, length(w) - 2) ELSE left(w, length(w) - 1) END",
            "ies": "CASE WHEN length(w) > 4 THEN left(w, length(w) - 2) ELSE left(w, length(w) - 1) END",
            "us": "w",
            "ss": "w",
            "s": f"CASE WHEN regexp_matches(left(w, length(w) - 2), '{_V}')"
            " THEN left(w, length(w) - 1) ELSE w END",
        }
    )
    participle = _endings(
        {
            "eed": _cut("eed", "ee", "r1"),
            "eedly": _cut("eedly", "ee", "r1"),
            **{e: _drop_participle(e) for e in ("ed", "edly", "ing", "ingly")},
        }
    )
    final_y = (
        "CASE WHEN length(w) > 2 AND right(w, 1) IN ('y', 'Y')"
        " AND NOT regexp_matches(right(w, 2), '^[aeiouy]')"
        " THEN left(w, length(w) - 1) || 'i' ELSE w END"
    )
    second = {e: _cut(e, n, "r1") for e, n in zip(_SECOND[::2], _SECOND[1::2], strict=True)}
    second["ogi"] = _cut("ogi", "og", "r1", "ends_with(w, 'logi')")
    second["li"] = _cut("li", "", "r1", "regexp_matches(w, '[cdeghkmnrt]li$')")
    third = {e: _cut(e, n, "r1") for e, n in zip(_THIRD[::2], _THIRD[1::2], strict=True)}
    third |= {e: _cut(e, "", "r1") for e in _THIRD_DROPPED}
    third["ative"] = _cut("ative", "", "r2")
    fourth = {e: _cut(e, "", "r2") for e in _FOURTH}
    fourth["ion"] = _cut("ion", "", "r2", "regexp_matches(w, '[st]ion$')")
    fifth = f"""CASE
      WHEN ends_with(w, 'e') AND (length(w) - 1 >= r2 OR (length(w) - 1 >= r1
        AND NOT regexp_matches(left(w, length(w) - 1), '{_SHORT}'))) THEN left(w, length(w) - 1)
      WHEN ends_with(w, 'll') AND length(w) - 1 >= r2 THEN left(w, length(w) - 1)
      ELSE w END"""
    return [plural, participle, final_y, _endings(second), _endings(third), _endings(fourth), fifth]


def stems(vocabulary: str) -> str:
    """CTE ``stems`` (term, stem) of a relation with distinct ``term``."""
    whole = " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in zip(_WHOLE[::2], _WHOLE[1::2], strict=True))
    parts = [
        f"""
  stem_0 AS MATERIALIZED (
    SELECT term, regexp_full_match(term, '\\p{{L}}+') AND length(term) > 2 AS plain,
      regexp_replace(regexp_replace(term, '^y', 'Y'), '([aeiouy])y', '\\1Y', 'g') AS w
    FROM {vocabulary}),
  stem_r1 AS (
    SELECT *, CASE WHEN regexp_matches(w, '^(gener|arsen)') THEN 5 WHEN starts_with(w, 'commun') THEN 6
      WHEN regexp_matches(w, '{_REGION}') THEN length(regexp_extract(w, '{_REGION}'))
      ELSE length(w) END AS r1 FROM stem_0),
  stem_1 AS (
    SELECT *, CASE WHEN regexp_matches(substr(w, r1 + 1), '{_REGION}')
      THEN r1 + length(regexp_extract(substr(w, r1 + 1), '{_REGION}')) ELSE length(w) END AS r2
    FROM stem_r1)"""
    ]
    for n, step in enumerate(_steps(), start=1):
        kept = f"w IN ({_list(_UNCHANGED_AFTER_1A)})" if n > 1 else "false"
        parts.append(
            f"""
  stem_{n + 1} AS (
    SELECT term, plain, r1, r2, CASE WHEN {kept} THEN w ELSE {step} END AS w FROM stem_{n})"""
        )
    last = len(_steps()) + 1
    parts.append(
        f"""
  stems AS MATERIALIZED (
    SELECT term, CASE WHEN NOT plain THEN term
      ELSE CASE term {whole} ELSE replace(w, 'Y', 'y') END END AS stem FROM stem_{last})"""
    )
    return ",".join(parts)
