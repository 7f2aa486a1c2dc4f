"""Query of operator 10: the contract's three phrases and further licence notices."""

from __future__ import annotations

from pyspark.sql import functions as F

from .licenses import Template, scan_licenses
from .q_decontamination import WORDS
from .registry import query, table

# Licence notices and the labels they stand for.
TEMPLATES = [
    Template("mit", "under the mit license", base=True),
    Template("apache-2", "apache license version 2", base=True),
    Template("cc-by-nc", "cc by nc", base=True),
    Template("agpl-3", "gnu affero general public license version 3"),
    Template("apache-2", "licensed under the apache license version 2 0", "apache license version 2"),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted",
             "redistribution and use in source and binary forms"),
    Template("cc-by", "creative commons attribution"),
    Template("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
    Template("cc-by-sa", "licensed under cc by sa", "cc by sa"),
    Template("gpl-2", "gnu general public license version 2"),
    Template("gpl-3", "this work is licensed under the gnu general public license version 3",
             "gnu general public license version 3"),
    Template("lgpl", "gnu lesser general public license"),
    Template("mit", "released under the mit license", "mit license"),
    Template("mpl-2", "mozilla public license version 2"),
]


def _sql() -> str:
    def array(words: list[str]) -> str:
        return "[" + ", ".join(f"'{w}'" for w in words) + "]"

    rows = []
    for n, t in enumerate(TEMPLATES):
        at, part = t.phrase_place()
        phrase = f"w[s + {at}:s + {at + len(part) - 1}] = {array(part)}"
        fit = " + ".join(f"CAST(coalesce(w[s + {i}] = '{x}', false) AS INT)" for i, x in enumerate(t.words()))
        last = len(t.words())
        rows.append(
            f"SELECT doc_id, s - 1 AS start, '{t.label}' AS label, {str(t.base).lower()} AS base, ({fit}) / {last}.0 AS score "
            f"FROM p WHERE anchor = {n} AND {phrase} AND {{rare{n}}}"
        )
    anchors = " UNION ALL ".join(
        f"SELECT {n} AS anchor, {at} AS at, '{part[-1]}' AS word, {at + len(part) - 1} AS back"
        for n, t in enumerate(TEMPLATES) for at, part in [t.phrase_place()]
    )
    vocabulary = array(sorted({x for t in TEMPLATES for x in t.words()}))
    body = " UNION ALL ".join(rows)
    for n in range(len(TEMPLATES)):  # the three rarest words of the template must stand at their places
        body = body.replace(
            f"{{rare{n}}}",
            f"len(list_filter((SELECT o FROM orders WHERE t = {n}), lambda r: coalesce(w[s + r.i], '') <> r.x)) = 0",
        )
    orders = " UNION ALL ".join(
        f"SELECT {n} AS t, list({{'i': i, 'x': x}}) AS o FROM (SELECT i, x FROM (VALUES "
        + ", ".join(f"({i}, '{x}')" for i, x in enumerate(t.words()))
        + ") v(i, x) LEFT JOIN df ON df.word = x ORDER BY coalesce(n, 0), i LIMIT 3)"
        for n, t in enumerate(TEMPLATES)
    )
    return f"""
WITH d AS (SELECT doc_id, {WORDS} AS w FROM documents),
df AS (SELECT word, count(*) AS n FROM (SELECT DISTINCT doc_id, unnest(w) AS word FROM d)
       WHERE list_contains({vocabulary}, word) GROUP BY word),
orders AS ({orders}),
e AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS q FROM d),
p AS (SELECT doc_id, w, anchor, q - back AS s FROM e JOIN ({anchors}) a ON w[q] = a.word WHERE q - back >= 1),
found AS ({body}),
per_doc AS (
    SELECT doc_id, count(*) FILTER (base) AS n_base, min(start) FILTER (base) AS first_word,
           max(start) FILTER (base) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) AS base_labels,
           string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(score) AS score
    FROM found GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, CAST(coalesce(score, 0) AS DOUBLE) AS score
FROM d LEFT JOIN per_doc USING (doc_id)
"""


SQL = _sql()


@query("op10_license_scan", SQL)
def op10_license_scan(spark, sf):
    found = scan_licenses(table(spark, sf, "documents"), "doc_id", "text", TEMPLATES)
    return found.withColumns({c: F.array_join(c, ",") for c in ("base_labels", "labels")})
