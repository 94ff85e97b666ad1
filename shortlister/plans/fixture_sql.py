"""SQL of the fixtures, as chains of common table expressions for DuckDB."""

#: q, tv, tool, dots, sc, gold'd scores ``s``.
FX1 = """WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS vec, label FROM embeddings),
q AS (SELECT ['I1','I2','I3'][CAST((vec_id//10)%3 AS INTEGER)+1] AS split, 'q' || vec_id AS query_id, vec_id//10 AS q_ord, vec FROM v WHERE vec_id%10=0),
tv0 AS (SELECT CAST((vec_id-vec_id//10-1)//3 AS INTEGER) AS tool_idx, CAST((vec_id-vec_id//10-1)%3 AS INTEGER) AS slot, label, vec FROM v WHERE vec_id%10<>0),
tv AS (SELECT tool_idx, slot, label, CASE WHEN slot=2 AND tool_idx%7=0 THEN list_transform(vec, lambda x: CAST(0.0 AS DOUBLE)) ELSE vec END AS vec FROM tv0),
tool AS (SELECT tool_idx, 'cat' || label AS category, tool_idx//3 AS service, 'cat' || label || '__svc' || (tool_idx//3) || '__api' || tool_idx AS id FROM tv WHERE slot=0),
dots AS MATERIALIZED (SELECT split, query_id, q_ord, tool_idx, slot, label, list_inner_product(q.vec, tv.vec) AS d FROM q, tv),
sc AS (SELECT split, query_id, q_ord, tool_idx, max(d) AS s_multi, max(CASE WHEN slot=0 THEN d END) AS s_single FROM dots GROUP BY ALL),
rk0 AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s_single DESC, tool_idx) AS r FROM sc),
s AS MATERIALIZED (SELECT split, query_id, q_ord, tool_idx, s_multi, s_single,
  CASE split WHEN 'I1' THEN r = 1+(q_ord*7)%11 WHEN 'I2' THEN r = 1+(q_ord*7)%2 OR r = 3+(q_ord*5)%3 ELSE r <= 2 OR r = 3+q_ord%2 END AS is_gold FROM rk0)"""

#: FX1 and folds, priors, ``b``: everything that fusion needs.
BASE = FX1 + """,
folds AS (SELECT split, query_id, (row_number() OVER (PARTITION BY split ORDER BY md5('42::' || query_id))-1)%5 AS fold FROM q),
near AS (SELECT query_id, label, row_number() OVER (PARTITION BY query_id ORDER BY d DESC, tool_idx, slot) AS n FROM dots WHERE q_ord%17<>16),
pr AS (SELECT query_id, 'cat' || label AS category, count(*)/10.0::DOUBLE AS p FROM near WHERE n<=10 GROUP BY ALL),
b AS MATERIALIZED (SELECT s.*, tool.category, tool.service, tool.id, fold, max(CASE WHEN is_gold THEN 1.0::DOUBLE ELSE 0.0 END) OVER (PARTITION BY s.query_id, tool.category) AS p_oracle, coalesce(pr.p, 0.0)::DOUBLE AS p_real
  FROM s JOIN tool USING (tool_idx) JOIN folds USING (split, query_id) LEFT JOIN pr ON pr.query_id=s.query_id AND pr.category=tool.category)"""


def fusion(prior: str, score: str = "s_multi") -> str:
    """BASE, grids, z parameters, and per method the recall of each combination and the chosen one."""
    return BASE + f""",
held AS (SELECT unnest(range(5)) AS held),
z AS (SELECT split, held, avg({score}) AS mean, CASE WHEN stddev_pop({score})>1e-8 THEN stddev_pop({score}) ELSE 1.0 END AS std FROM b, held WHERE fold<>held GROUP BY ALL),
ga AS (SELECT row_number() OVER (ORDER BY i, j)-1 AS pos, [0.3,0.5,0.7][i]::DOUBLE AS alpha, [0.1,0.3,0.5,0.7][j]::DOUBLE AS beta FROM range(1,4) a(i), range(1,5) c(j)),
gm AS (SELECT k-1 AS pos, [0.1,0.25,0.5,1.0][k]::DOUBLE AS lam FROM range(1,5) d(k)),
fa AS (SELECT b.split, query_id, tool_idx, is_gold, z.held, pos, alpha, beta, alpha*({score}-mean)/std + beta*{prior} AS f FROM b JOIN z ON z.split=b.split AND fold<>held, ga),
ra AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY split, query_id, held, pos ORDER BY f DESC, tool_idx) AS rk FROM fa),
ha AS (SELECT split, query_id, held, pos, alpha, beta, max(CASE WHEN is_gold THEN rk END) AS mg FROM ra GROUP BY ALL),
ca AS (SELECT split, held, pos, alpha, beta, avg(CASE WHEN mg<=10 THEN 1.0 ELSE 0.0 END) AS recall FROM ha GROUP BY ALL),
ba AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY split, held ORDER BY recall DESC, beta, pos) AS n FROM ca) WHERE n=1),
fm AS (SELECT b.split, query_id, tool_idx, is_gold, held, pos, lam, {score}*pow(greatest({prior}, 0.05), lam) AS f FROM b, held, gm WHERE fold<>held),
rm AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY split, query_id, held, pos ORDER BY f DESC, tool_idx) AS rk FROM fm),
hm AS (SELECT split, query_id, held, pos, lam, max(CASE WHEN is_gold THEN rk END) AS mg FROM rm GROUP BY ALL),
cm AS (SELECT split, held, pos, lam, avg(CASE WHEN mg<=10 THEN 1.0 ELSE 0.0 END) AS recall FROM hm GROUP BY ALL),
bm AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY split, held ORDER BY recall DESC, lam, pos) AS n FROM cm) WHERE n=1),
usea AS (SELECT b.split, b.query_id, b.tool_idx, id, is_gold, fold, ba.alpha*({score}-round(mean,6))/round(std,6) + ba.beta*{prior} AS f FROM b JOIN z ON z.split=b.split AND z.held=fold JOIN ba ON ba.split=b.split AND ba.held=fold),
usem AS (SELECT b.split, b.query_id, b.tool_idx, id, is_gold, fold, {score}*pow(greatest({prior}, 0.05), bm.lam) AS f FROM b JOIN bm ON bm.split=b.split AND bm.held=fold)"""

#: FX1, generated texts ``g``, their blocks ``bl``, calls ``ca``, statuses ``st``, scored records ``rec``.
CALLS = FX1 + r""",
rm AS (SELECT s.*, id, row_number() OVER (PARTITION BY query_id ORDER BY s_multi DESC, s.tool_idx) AS rk FROM s JOIN tool USING (tool_idx)),
cand AS MATERIALIZED (SELECT split, query_id, q_ord, list(id ORDER BY rk) FILTER (rk<=10) AS cands, list(id ORDER BY id) FILTER (is_gold) AS gold FROM rm GROUP BY ALL),
nq AS (SELECT count(*) AS n FROM q),
e0 AS (SELECT event_id AS i, user_id, event_type, cand.*, CASE WHEN event_id%12<10 THEN regexp_replace(cands[CAST(1+event_id%12 AS INTEGER)], '[^A-Za-z0-9_-]', '_', 'g') ELSE 'unknown_' || event_id END AS name FROM events, nq JOIN cand ON q_ord=event_id%n),
e1 AS (SELECT *, '<function=' || name || '>' || chr(10) || CASE WHEN i%7=0 THEN '' ELSE '<parameter=q>' || chr(10) || user_id || chr(10) || '</parameter>' || chr(10) END || '<parameter=limit>' || CASE WHEN i%3=0 THEN '12.5' ELSE CAST(i%50 AS VARCHAR) END || '</parameter>' || chr(10) || CASE WHEN i%5=0 THEN '<parameter=zz>1</parameter>' || chr(10) ELSE '' END || '</function>' AS xml FROM e0),
g AS MATERIALIZED (SELECT i AS event_id, user_id, event_type, split, query_id, cands, gold, CASE event_type
 WHEN 'click' THEN 'Sure.' || chr(10) || '<tool_call>' || chr(10) || xml || chr(10) || '</tool_call>'
 WHEN 'view' THEN '<tool_call>{"name": "' || name || '", "arguments": {"q": "' || user_id || '", "limit": ' || (i%50) || '}}</tool_call>'
 WHEN 'purchase' THEN xml || xml
 WHEN 'error' THEN 'Sure.' || chr(10) || '<tool_call>' || chr(10) || xml || chr(10) || '</tool_call><tool_call>{"name": broken</tool_call>'
 ELSE 'I can''t help with that.' END AS gen FROM e1),
b0 AS (SELECT event_id, gen, regexp_extract_all(gen, '<tool_call>\s*(.*?)\s*</tool_call>', 1, 's') AS marked FROM g),
b1 AS MATERIALIZED (SELECT event_id, CASE WHEN len(marked)>0 THEN marked WHEN regexp_matches(gen, '<function=([^>\s]+)\s*>(.*?)</function>', 's') THEN [gen] ELSE [] END AS bs FROM b0),
bl AS (SELECT event_id, generate_subscripts(bs, 1) AS pos, unnest(bs) AS block FROM b1),
c0 AS (SELECT *, regexp_matches(block, '<function=([^>\s]+)\s*>(.*?)</function>', 's') AS is_xml, regexp_extract(block, '<function=([^>\s]+)\s*>(.*?)</function>', 2, 's') AS body FROM bl),
ca AS MATERIALIZED (SELECT event_id, pos, 'xml' AS kind, regexp_extract(block, '<function=([^>\s]+)\s*>(.*?)</function>', 1, 's') AS name, map_from_entries(list_transform(list_zip(regexp_extract_all(body, '<parameter=([^>\s]+)\s*>(.*?)</parameter>', 1, 's'), regexp_extract_all(body, '<parameter=([^>\s]+)\s*>(.*?)</parameter>', 2, 's')), lambda x: {'k': x[1], 'v': trim(x[2], ' ' || chr(10) || chr(9) || chr(13))})) AS args FROM c0 WHERE is_xml
 UNION ALL SELECT event_id, pos, 'json', block->>'$.name', map_from_entries(list_transform(json_keys(block, '$.arguments'), lambda k: {'k': k, 'v': json_extract_string(block, '$.arguments.' || k)})) FROM c0 WHERE NOT is_xml AND json_valid(block)),
st AS MATERIALIZED (SELECT b1.event_id, max(len(bs)) AS n_blocks, count(ca.name) AS n_calls, CASE WHEN max(len(bs))=0 THEN 'no_call' WHEN count(ca.name)<max(len(bs)) THEN 'malformed' ELSE 'ok' END AS gen_status FROM b1 LEFT JOIN ca USING (event_id) GROUP BY b1.event_id),
cv AS (SELECT ca.*, list_filter(['q'], lambda k: NOT list_contains(map_keys(args), k)) AS missing, list_sort(list_filter(map_keys(args), lambda k: NOT list_contains(['q','limit'], k))) AS unknown,
 CASE WHEN list_contains(map_keys(args), 'limit') AND NOT regexp_full_match(args['limit'], '\s*[+-]?[0-9]+\s*') THEN ['limit'] ELSE [] END AS bad FROM ca),
ct AS MATERIALIZED (SELECT cv.*, len(missing)=0 AND len(unknown)=0 AND len(bad)=0 AS valid, list_filter(cands, lambda c: regexp_replace(c, '[^A-Za-z0-9_-]', '_', 'g')=name)[-1] AS tool_id FROM cv JOIN g USING (event_id)),
cl AS (SELECT event_id, coalesce(list(tool_id ORDER BY pos) FILTER (tool_id IS NOT NULL), []) AS ids, count(*) AS n_calls, count(*) FILTER (tool_id IS NULL) AS hall FROM ct GROUP BY event_id),
vv AS (SELECT event_id, avg(CASE WHEN valid THEN 1.0 ELSE 0.0 END) AS av FROM ct JOIN g USING (event_id) WHERE list_contains(gold, tool_id) GROUP BY event_id),
r0 AS (SELECT g.*, gen_status, coalesce(ids, []) AS ids, CAST(coalesce(cl.n_calls, 0) AS INTEGER) AS n_calls, CAST(coalesce(hall, 0) AS INTEGER) AS hallucinated_calls, av AS args_valid,
 len(list_filter(coalesce(ids, []), lambda t: list_contains(gold, t))) AS rt, list_has_all(coalesce(ids, []), gold) AS done, list_has_all(cands, gold) AS inside, list_has_all(gold, coalesce(ids, [])) AS no_other FROM g JOIN st USING (event_id) LEFT JOIN cl USING (event_id) LEFT JOIN vv USING (event_id)),
rec AS MATERIALIZED (SELECT *, CASE WHEN split='I1' THEN CASE WHEN rt>0 THEN 1.0 ELSE 0.0 END WHEN len(ids)=0 THEN 0.0 ELSE rt/len(ids) END::DOUBLE AS func_acc, CASE WHEN done THEN 1.0 ELSE 0.0 END::DOUBLE AS completeness,
 CASE WHEN done THEN NULL WHEN NOT inside THEN 'retrieval_miss' ELSE 'generation_miss' END AS miss_type, CAST(inside AS INTEGER) AS recall_all, CASE WHEN len(ids)>0 AND no_other AND done AND hallucinated_calls=0 THEN 1.0 ELSE 0.0 END::DOUBLE AS exact_match,
 CASE WHEN len(ids)>0 AND no_other AND done AND hallucinated_calls=0 AND args_valid=1 THEN 1.0 ELSE 0.0 END::DOUBLE AS strict_success FROM r0)"""
