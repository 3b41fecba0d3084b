"""op2: license notices in every document, with SQL that states the result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .common import LOWER, UPPER, table
from .license_scan import CONTAINMENT, PHRASES, TELLING, TEMPLATES, WORD, need, scan, tokens_of, width


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


def _list(values: list[str]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def oracle() -> str:
    """The same result by direct counting of every window of every text, without filters."""
    places, flags = [], []
    for i, (phrase, label) in enumerate(PHRASES):
        parts = phrase.split()
        test = " and ".join(f"w[i + {k + 1}] = '{p}'" for k, p in enumerate(parts))
        places.append(f"list_filter(range(len(w)), lambda i: {test}) as at{i}")
        flags.append(f"case when len(at{i}) > 0 then ['{label}'] else [] end")
    both = "list_concat(list_concat({}, {}), {})"
    every = both.format(*(f"at{i}" for i in range(len(PHRASES))))
    base = both.format(*flags)
    best = []
    for text, label in TEMPLATES:
        t = tokens_of(text)
        told = "".join(f" and list_contains(b, '{x}')" for x in t if x in TELLING)
        window = f"select doc_id, unnest(list_transform(range(1, len(w) + 1), lambda i: w[i : i + {width(text, CONTAINMENT) - 1}])) as b from worded"
        best.append(f"select doc_id, '{label}' as label, len(list_intersect(list_distinct(b), {_list(t)})) as n, {len(t)} as size, {need(len(t), CONTAINMENT)} as need from ({window}) where true{told}")
    return f"""
with docs as (select doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') as low from documents),
worded as (select doc_id, low, regexp_extract_all(low, '{WORD}') as w from docs),
placed as (select doc_id, len(w) as n_words, {", ".join(places)} from worded),
held as ({" union all ".join(best)}),
found as (select doc_id, list(distinct label) as more, max(n / size) as part from held where n >= need group by doc_id),
based as (select doc_id, n_words, list_sort({every}) as every, {base} as base from placed)
select doc_id, n_words, len(every) as n_base, every[1] as first_word, every[-1] as last_word,
  array_to_string(list_sort(list_distinct(base)), ',') as base_labels,
  array_to_string(list_sort(list_distinct(list_concat(base, coalesce(more, [])))), ',') as labels,
  case when len(base) > 0 then 1.0 else coalesce(part, 0.0) end::double as score
from based left join found using (doc_id)"""


QUERIES = {"op2_license_scan": op2_license_scan}
ORACLES = {"op2_license_scan": oracle()}
