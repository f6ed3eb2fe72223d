"""SQL for the results of those corpus queries that SQL can express."""

from __future__ import annotations

from .licenses import CONTAINED, SHINGLE, TEMPLATES, _words

#: Every window of 50 bytes (by a 64-bit hash), the least document it is in, and the bytes that later ones cover.
SUFFIXES = """
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS h FROM documents),
w AS (SELECT doc_id, i, hash(array_slice(h, i + 1, i + 50)) AS s FROM (SELECT doc_id, h, unnest(range(0, greatest(0, octet_length(h) - 49))) AS i FROM d) t),
m AS (SELECT s, min(doc_id) AS least FROM w GROUP BY s HAVING min(doc_id) < max(doc_id)),
g AS (SELECT w.doc_id, w.i FROM w JOIN m ON w.s = m.s WHERE m.least < w.doc_id),
b AS (SELECT doc_id, h, unnest(range(0, octet_length(h))) AS p FROM d WHERE doc_id IN (SELECT doc_id FROM g)),
c AS (SELECT b.doc_id, b.p, hex(array_slice(b.h, b.p + 1, b.p + 1)) AS x,
      count(g.i) OVER (PARTITION BY b.doc_id ORDER BY b.p ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) > 0 AS gone
      FROM b LEFT JOIN g ON b.doc_id = g.doc_id AND b.p = g.i),
r AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY p), false) AS begins FROM c),
a AS (SELECT doc_id, count(*) FILTER (gone) AS n_removed, count(*) FILTER (begins) AS n_spans, coalesce(string_agg(x, '' ORDER BY p) FILTER (NOT gone), '') AS kept FROM r GROUP BY doc_id)
SELECT d.doc_id, CAST(octet_length(d.h) AS BIGINT) AS n_bytes, CAST(coalesce(a.n_removed, 0) AS BIGINT) AS n_removed,
       CAST(coalesce(a.n_spans, 0) AS BIGINT) AS n_spans, sha256(coalesce(unhex(a.kept), d.h)) AS kept_sha256
FROM d LEFT JOIN a ON d.doc_id = a.doc_id
"""


def license_scan(templates: dict[str, str] = TEMPLATES) -> str:
    """Template shingles looked up in all texts, counted in the windows that the operator has."""
    rows = []
    for name, text in sorted(templates.items()):
        words = _words(text)
        k = min(SHINGLE, len(words))
        shingles = sorted({" ".join(words[i : i + k]) for i in range(len(words) - k + 1)})
        step = 1 << (len(shingles) - 1).bit_length()
        rows += [f"('{name}', {k}, {step}, {len(shingles)}, '{s}')" for s in shingles]
    sizes = sorted({min(SHINGLE, len(_words(t))) for t in templates.values()})
    runs = " UNION ALL ".join(
        f"SELECT doc_id, {k} AS k, i AS at, array_to_string(list_slice(words, i + 1, i + {k}), ' ') AS shingle "
        f"FROM (SELECT doc_id, words, unnest(range(0, greatest(0, len(words) - {k - 1}))) AS i FROM d) t{k}"
        for k in sizes
    )
    return f"""
WITH t(license, k, step, n, shingle) AS (VALUES {", ".join(rows)}),
d AS (SELECT doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^a-z0-9]+'), lambda x: x <> '') AS words FROM documents),
s AS ({runs}),
h AS (SELECT s.doc_id, t.license, t.n, t.shingle, s.at // t.step * t.step AS one, t.step FROM s JOIN t ON s.k = t.k AND s.shingle = t.shingle),
w AS (SELECT doc_id, license, n, shingle, one AS win FROM h UNION ALL SELECT doc_id, license, n, shingle, one - step FROM h WHERE one >= step),
c AS (SELECT doc_id, license, count(DISTINCT shingle) / CAST(n AS DOUBLE) AS contained FROM w GROUP BY doc_id, license, n, win),
b AS (SELECT doc_id, license, max(contained) AS contained FROM c WHERE contained >= {CONTAINED} GROUP BY doc_id, license),
a AS (SELECT doc_id, string_agg(license, ',' ORDER BY license) AS licenses, count(*) AS n_licenses, max(contained) AS contained FROM b GROUP BY doc_id)
SELECT x.doc_id, coalesce(a.licenses, '') AS licenses, CAST(coalesce(a.n_licenses, 0) AS BIGINT) AS n_licenses, coalesce(a.contained, 0.0) AS contained
FROM documents x LEFT JOIN a ON x.doc_id = a.doc_id
"""


def oracle_sql() -> dict[str, str]:
    return {"op8_suffix_array_dedup": SUFFIXES, "op10_license_scan": license_scan()}
