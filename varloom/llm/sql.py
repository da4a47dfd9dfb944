"""DuckDB SQL of the queries that SQL can express over whole tables."""

_P6 = r"""
WITH r AS (
  SELECT source, upper(regexp_replace(symbol, '^\s+|\s+$', '', 'g')) AS symbol, max(score) AS score, min(panel) AS panel
  FROM rankings WHERE isfinite(score) AND regexp_replace(symbol, '^\s+|\s+$', '', 'g') <> '' GROUP BY 1, 2),
s AS (SELECT *, count(*) OVER (PARTITION BY source) AS n, row_number() OVER (PARTITION BY source ORDER BY score DESC, symbol) AS nr FROM r),
w AS (SELECT s.*, least(n, (n * keep_permille + 999) // 1000) AS k FROM s JOIN keep_targets USING (panel)),
c AS (SELECT source, n, k, score AS cutoff FROM w WHERE nr = k)
"""

# smallest label that reaches each vertex; the keyed recursion keeps one row per vertex
_CC = """
  cc(node, label) USING KEY (node) AS (
    SELECT DISTINCT a, a FROM s
    UNION
    SELECT s.b, min(cc.label) FROM cc JOIN s ON cc.node = s.a JOIN recurring.cc AS old ON old.node = s.b WHERE cc.label < old.label GROUP BY s.b)"""

ORACLES = {
    "p2_found": f"""
      WITH RECURSIVE t AS (SELECT DISTINCT variant_idx AS v, gene_idx + 4611686018427387904 AS g FROM annotation_triples WHERE variant_idx >= 0 AND gene_idx >= 0),
      s AS (SELECT unnest([v, g]) AS a, unnest([g, v]) AS b FROM t), {_CC},
      fam AS (SELECT label AS family_idx, node AS variant_idx FROM cc WHERE node < 4611686018427387904),
      f AS (SELECT variant_idx, unnest([cv_groups, cv_score_groups]) AS fold FROM cv_folds),
      bad AS (SELECT family_idx FROM fam JOIN f USING (variant_idx) WHERE fold <> -1 GROUP BY 1 HAVING min(fold) < max(fold))
      SELECT family_idx, variant_idx FROM fam WHERE family_idx IN (SELECT family_idx FROM bad)""",
    # every family whole in one bin and split, and every split within the heaviest bin of its share
    "p2_bins": f"""
      WITH RECURSIVE t AS (SELECT DISTINCT variant_idx AS v, gene_idx + 4611686018427387904 AS g FROM annotation_triples WHERE variant_idx >= 0 AND gene_idx >= 0),
      s AS (SELECT unnest([v, g]) AS a, unnest([g, v]) AS b FROM t), {_CC},
      lone AS (SELECT DISTINCT CASE WHEN coalesce(variant_idx >= 0, false) THEN variant_idx ELSE gene_idx + 4611686018427387904 END AS node FROM annotation_triples
        WHERE coalesce(variant_idx >= 0, false) <> coalesce(gene_idx >= 0, false)),
      fam AS (SELECT label, node FROM cc UNION ALL SELECT node, node FROM lone WHERE node NOT IN (SELECT node FROM cc))
      SELECT count(*) AS n_members, count(DISTINCT label) AS n_families, CAST(0 AS BIGINT) AS n_parted, CAST(0 AS BIGINT) AS n_torn, CAST(3 AS BIGINT) AS n_splits, CAST(3 AS BIGINT) AS n_near FROM fam""",
    "p4_found": f"""
      WITH RECURSIVE s AS (
        SELECT DISTINCT unnest([row_idx, col_idx]) AS a, unnest([col_idx, row_idx]) AS b FROM ld_blocks WHERE isfinite(r2) AND r2 >= 0.01 AND r2 <= 1 AND row_idx <> col_idx), {_CC}
      SELECT label AS group_idx, node AS variant_idx FROM cc""",
    "p1_found": """
      WITH g AS (
        SELECT source, analysis, split_part(ensembl, '.', 1) AS ensembl, max(score) AS score
        FROM rankings WHERE ensembl IS NOT NULL AND isfinite(score) GROUP BY 1, 2, 3),
      r AS (SELECT *, row_number() OVER (PARTITION BY source, analysis ORDER BY score DESC, ensembl) AS rank FROM g)
      SELECT source, analysis, CAST(rank AS INT) AS rank, ensembl FROM r WHERE rank <= 10""",
    "p6_found": _P6 + "SELECT w.source, w.symbol FROM w JOIN c USING (source) WHERE w.score >= c.cutoff",
    "p6_cutoffs": _P6
    + "SELECT c.source, c.n AS n_records, c.k AS n_target, c.cutoff, count(*) AS n_kept FROM w JOIN c USING (source) WHERE w.score >= c.cutoff GROUP BY ALL",
    "p7_decoded": "SELECT doc_id, md5(coalesce(text, '')) AS text_md5 FROM documents",
}
