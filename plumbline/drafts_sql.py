"""SQL for DuckDB of the drafts that a catalog gives, by their rules, over the counts of all values of all columns."""

from __future__ import annotations

#: Columns of the views by type family.
VIEWS = {
    "clinic.appointments": {"id": "numeric", "patient": "numeric", "schedule_date": "date", "completed": "numeric", "status": "string", "is_deleted": "numeric", "practice": "numeric"},
    "clinic.invoices": {"appointment": "numeric", "line": "numeric", "part": "numeric", "supplier": "numeric", "invoice_date": "date", "active": "numeric", "total": "numeric"},
    "clinic.patients": {"id": "numeric", "active": "numeric", "nhi": "string", "high_care": "numeric", "balance": "float", "practice": "numeric"},
    "clinic.sentinels": {"visitid": "numeric", "seen_at": "date", "status": "string", "channel": "string"},
}

RULES = """, cols AS (
  SELECT view, col, family, CAST(sum(n) AS BIGINT) AS total, count(value) AS distinct_n, coalesce(sum(n) FILTER (value IS NULL), 0) AS nulls,
         min(number) AS least, min(value) FILTER (family = 'date') AS first_day, max(value) FILTER (family = 'date') AS last_day
  FROM vals GROUP BY ALL
), classed AS MATERIALIZED (
  SELECT *, CASE WHEN family = 'numeric' AND regexp_matches(col, '(id|key)$') THEN 'key' WHEN col = 'nhi' THEN 'hidden' WHEN distinct_n <= 200 THEN 'coded' WHEN family = 'string' THEN 'hidden' ELSE 'measure' END AS class,
         total > 0 AND distinct_n = total AS unique_key, view <> 'clinic.sentinels' AS usable, split_part(view, '.', 2) || '-' || replace(col, '_', '-') AS slug, ' in ' || col || ' (' || view || ')' AS place
  FROM cols
), tops AS (
  SELECT v.*, row_number() OVER (PARTITION BY v.view, v.col ORDER BY n DESC, value NULLS FIRST) AS rank FROM vals v
), firsts AS (
  SELECT t.view, t.col, max(value) FILTER (rank = 1) AS v1, max(n) FILTER (rank = 1) AS n1, max(n) FILTER (rank = 2) AS n2, bool_or(value = '' AND rank <= 20) AS empty,
         count(value) FILTER (rank <= 20 AND n >= greatest(0.001 * total, 50)) AS shown
  FROM tops t JOIN cols c ON c.view = t.view AND c.col = t.col GROUP BY t.view, t.col
), pairs AS (
  SELECT a.view AS va, a.col AS ca, b.view AS vb, b.col AS cb FROM classed a JOIN classed b ON a.family = b.family AND a.view <> b.view
  WHERE a.family IN ('numeric', 'string') AND a.class <> 'measure' AND b.class <> 'measure' AND b.unique_key AND a.usable
    AND (a.class = 'key' OR b.class = 'key' OR regexp_matches(a.col, 'id|code|key') OR regexp_matches(b.col, 'id|code|key') OR a.distinct_n >= 0.5 * a.total OR b.distinct_n >= 0.5 * b.total)
), known AS (
  SELECT DISTINCT view, col, same FROM vals WHERE value IS NOT NULL
), met AS (
  SELECT p.va, p.ca, p.vb, p.cb, count(*) AS common
  FROM pairs p JOIN known x ON x.view = p.va AND x.col = p.ca JOIN known y ON y.view = p.vb AND y.col = p.cb AND y.same = x.same GROUP BY ALL
), coded AS (
  SELECT * FROM classed JOIN firsts USING (view, col) WHERE usable AND class = 'coded'
)
SELECT c.slug || '-orphan-' || split_part(m.vb, '.', 2) AS slug, 'No row of ' || m.vb || ' for this ' || m.ca || ' (' || m.va || ')' AS title, 'referential' AS category, m.va AS view
FROM met m JOIN classed c ON c.view = m.va AND c.col = m.ca WHERE m.common < c.distinct_n AND round(m.common / c.distinct_n, 6) >= 0.5
UNION ALL SELECT slug || '-zero-or-negative-id', 'Stand-in value ''' || CAST(least AS BIGINT) || '''' || place, 'data-quality', view FROM classed WHERE usable AND class = 'key' AND least <= 0
UNION ALL SELECT slug || '-placeholder-date', 'Stand-in value ''' || d || '''' || place, 'data-quality', view FROM (SELECT *, unnest(list_distinct([first_day, last_day])) AS d FROM classed)
  WHERE usable AND left(d, 10) IN ('1900-01-01', '1753-01-01', '1970-01-01', '9999-12-31', '2099-12-31')
UNION ALL SELECT slug || '-empty-string-overload', 'Stand-in value ''''' || place, 'data-quality', view FROM coded WHERE nulls > 0 AND empty
UNION ALL SELECT slug || '-magic-value', 'Stand-in value ''' || coalesce(v1, 'NULL') || '''' || place, 'data-quality', view FROM coded WHERE coalesce(v1, 'NULL') <> '' AND n1 >= 20 AND n1 >= 3 * n2
UNION ALL SELECT slug || '-outside-domain', 'New code' || place, 'data-quality', view FROM coded WHERE family = 'string' AND shown >= 2
UNION ALL SELECT slug || '-future-date', col || ' later than now (' || view || ')', 'data-quality', view FROM classed WHERE usable AND family = 'date' AND class = 'measure' AND left(last_day, 19) > '{as_of}'
UNION ALL SELECT slug || '-duplicate', 'Same ' || col || ' on several rows (' || view || ')', 'data-quality', view FROM classed WHERE usable AND unique_key
"""


def drafts_sql(as_of: str) -> str:
    each = []
    for v, columns in VIEWS.items():
        for c, kind in columns.items():
            same = f"CAST({c} AS DECIMAL(38, 6))::VARCHAR" if kind == "numeric" else f"{c}::VARCHAR"
            number = f"{c}::DOUBLE" if kind == "numeric" else "NULL"
            each.append(f"SELECT '{v}' AS view, '{c}' AS col, '{kind}' AS family, {c}::VARCHAR AS value, {same} AS same, {number} AS number, count(*) AS n FROM {v.split('.')[1]} GROUP BY ALL")
    return f"WITH vals AS MATERIALIZED ({' UNION ALL '.join(each)}){RULES.replace('{as_of}', as_of)}"
