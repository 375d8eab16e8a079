"""DuckDB SQL for the queries of `catalogue`.

Positions are numbered through the stream of all shards; a match grows token
by token in a recursive join, which stops at the end of a document since a
separator has no token.
"""

from __future__ import annotations

from .catalogue import BOW, BUDGET_DOCS, BUDGET_TOKENS, CNF_D, CTX, DELIMS, GRAMS, K, MAX_CNT, MAX_DISP, MIN_LEN, STEPS, SUPPORT

_WORDS = r"coalesce(regexp_extract_all(lower(text), '[\p{L}\p{N}]+'), [])"

_BASE = f"""
d AS (SELECT doc_id, (doc_id % 2)::BIGINT AS shard, {_WORDS} AS t FROM documents WHERE doc_id IS NOT NULL),
lay AS (SELECT *, len(t)::BIGINT AS doc_len, row_number() OVER (ORDER BY shard, doc_id) - 1 AS doc_ix,
  (sum(len(t) + 1) OVER (PARTITION BY shard ORDER BY doc_id) - len(t) - 1)::BIGINT AS doc_start,
  (sum(len(t) + 1) OVER (ORDER BY shard, doc_id) - len(t))::BIGINT AS base FROM d),
tok AS (SELECT base + unnest(range(len(t))) AS g, unnest(t) AS token FROM lay),
b AS (SELECT item_id::BIGINT AS qid, {_WORDS} AS ids FROM benchmark),
"""


def _grams(*lengths: int, name: str = "q") -> str:
    values = ", ".join(f"({n})" for n in lengths or GRAMS)
    return f"""{name} AS (SELECT min(qid) AS qid, ids FROM (SELECT (qid * 10000 + l) * 10 + n AS qid, ids[l + 1:l + n] AS ids FROM (
  SELECT qid, ids, n, unnest(range(len(ids) - n + 1)) AS l FROM b, (VALUES {values}) v(n) WHERE len(ids) >= n)) GROUP BY ids),"""


def _ext(of: str = "q", key: str = "qid", tok: str = "tok", name: str = "ext") -> str:
    """name(key, n, g) for each match of the first n tokens of `of`'s ids at g, and the tokens as qt."""
    return f"""
qt_{name} AS (SELECT {key} AS k, unnest(range(len(ids))) AS i, unnest(ids) AS token FROM {of}),
{name} AS (
  SELECT k, 1::BIGINT AS n, g FROM qt_{name} JOIN {tok} USING (token) WHERE i = 0
  UNION ALL
  SELECT e.k, e.n + 1, e.g FROM {name} e JOIN qt_{name} s ON s.k = e.k AND s.i = e.n JOIN {tok} t ON t.g = e.g + e.n AND t.token = s.token
),"""


#: Whole matches with their document.
_HIT = """
hit AS (SELECT e.k AS qid, e.n, e.g, e.g - l.base AS pos, l.* FROM ext e JOIN q ON e.k = q.qid AND e.n = len(q.ids)
  ASOF JOIN lay_g l ON e.g >= l.lo),
"""
_LAYG = "lay_g AS (SELECT *, base AS lo FROM lay WHERE doc_len > 0),"


def _sql(*parts: str, then: str) -> str:
    return "WITH RECURSIVE " + _BASE.strip() + "\n" + "\n".join(parts).strip().rstrip(",") + "\n" + then


def _match(*lengths: int, then: str, more: str = "") -> str:
    return _sql(_grams(*lengths), _ext(), _LAYG, _HIT, more, then=then)


_PTR = "(doc_start + 1 + pos) * 4"
_NTD = "nt AS (SELECT qid, coalesce(t.token, '<eos>') AS token, count(*) AS cont_cnt FROM hit LEFT JOIN tok t ON t.g = hit.g + hit.n GROUP BY ALL), nd AS (SELECT *, (sum(cont_cnt) OVER (PARTITION BY qid))::BIGINT AS prompt_cnt FROM nt),"
_TAILS = "p AS (SELECT qid * 100000 + l AS qid, ids[l + 1:] AS ids FROM (SELECT qid, ids, unnest(range(len(ids))) AS l FROM b)),"
_PROMPT = "pr AS (SELECT qid, ids[:len(ids) - 1] AS ids, ids[len(ids)] AS cont FROM b WHERE len(ids) > 0), p AS (SELECT qid * 100000 + l AS qid, ids[l + 1:] AS ids FROM (SELECT qid, ids, unnest(range(len(ids))) AS l FROM pr)),"
#: Of each prompt the matches of its longest suffix.
_BACK = """suf AS (SELECT e.k // 100000 AS qid, e.n, e.g FROM ext e JOIN p ON e.k = p.qid AND e.n = len(p.ids)),
best AS (SELECT qid, max(n) AS suffix_len FROM suf GROUP BY qid),
fit AS (SELECT suf.*, suffix_len, t.token AS nxt FROM suf JOIN best USING (qid) LEFT JOIN tok t ON t.g = suf.g + suf.n WHERE n = suffix_len),"""
#: Prompts of which no suffix occurs: they get all positions, and a separator's token is <eos>.
_NONE = "unknown AS (SELECT qid, cont FROM pr WHERE qid NOT IN (SELECT qid FROM fit)), uni AS (SELECT token, count(*) AS n FROM tok GROUP BY token UNION ALL SELECT '<eos>', count(*) FROM d),"


def _shown(source: str, cols: str, before: str, after: str, order: str = "") -> str:
    lo = f"greatest(pos - {before}, 0)"
    hi = f"least(pos + {after}, doc_len)"
    return f"SELECT {cols}, doc_ix, doc_len, ({hi} - {lo})::BIGINT AS disp_len, (pos - {lo})::BIGINT AS needle_offset, array_to_string(t[{lo} + 1:{hi}], ' ') AS tokens FROM {source}"


_HALF = MAX_DISP // 2
def _cnf(three: bool = False) -> str:
    third = ", ({'clause': 2, 'term': 0, 'a': 8, 'n': 1})" if three else ""
    return f"""
c AS (SELECT (qid * 10000 + l) * 10 + x.a AS qid, x.clause AS clause, x.term AS term, ids[l + x.a:l + x.a + x.n - 1] AS ids FROM (SELECT qid, ids, unnest(range(0, len(ids) - 7, 8)) AS l FROM b WHERE len(ids) >= 8),
  (VALUES ({{'clause': 0, 'term': 0, 'a': 1, 'n': 2}}), ({{'clause': 0, 'term': 1, 'a': 3, 'n': 2}}), ({{'clause': 1, 'term': 0, 'a': 6, 'n': 1}}){third}) v(x)),
q AS (SELECT * FROM c),"""


_TERMS = """
m AS (SELECT hit.qid // 10 AS qid, c.clause, c.term, shard, doc_id, doc_start + 1 + pos AS p FROM hit JOIN c USING (qid)),
"""
_NEAR = f"EXISTS (FROM m x WHERE x.clause = %d AND x.qid = m.qid AND x.shard = m.shard AND x.doc_id = m.doc_id AND x.p BETWEEN m.p - {CNF_D} AND m.p + {CNF_D})"
_COMPAT = f"""
n AS (SELECT qid, shard, count(*) FILTER (clause = 0) AS n0, count(*) FILTER (clause = 1) AS n1 FROM m GROUP BY ALL),
f AS (SELECT m.qid, m.shard, m.doc_id, p FROM m JOIN n USING (qid, shard) WHERE n0 > 0 AND n1 > 0 AND clause = CASE WHEN n0 <= n1 THEN 0 ELSE 1 END),
s AS (SELECT DISTINCT m.qid, m.shard, m.doc_id, p FROM m JOIN n USING (qid, shard) WHERE n0 > 0 AND n1 > 0 AND clause = CASE WHEN n0 <= n1 THEN 1 ELSE 0 END),
a AS (SELECT f.*, x.p AS pl, x.doc_id AS dl FROM f ASOF LEFT JOIN s x ON f.qid = x.qid AND f.shard = x.shard AND f.p > x.p),
g AS (SELECT a.*, y.p AS pr, y.doc_id AS dr FROM a ASOF LEFT JOIN s y ON a.qid = y.qid AND a.shard = y.shard AND a.p <= y.p),
w AS (SELECT *, coalesce(pl + {CNF_D} >= p, false) AS okl, coalesce(pr <= p + {CNF_D}, false) AS okr FROM g),
win AS (
  SELECT qid, shard, CASE WHEN okl THEN pl ELSE p END AS l, CASE WHEN okr THEN pr ELSE p END AS r, CASE WHEN okl THEN dl ELSE doc_id END AS d1, CASE WHEN okr THEN dr ELSE doc_id END AS d2 FROM w WHERE okl OR okr
),
ok AS (SELECT qid, shard, d1 AS doc_id, l, r FROM win WHERE d1 = d2),
"""

_GREEDY = ["h0 AS (SELECT qid, g + n AS g FROM hit),"]
for _k in range(STEPS):
    _live = f"SELECT h.qid, h.g, coalesce(t.token, '<eos>') AS token FROM h{_k} h LEFT JOIN tok t ON t.g = h.g"
    _GREEDY.append(f"s{_k} AS (SELECT qid, token, count(*) AS cont_cnt FROM ({_live}) GROUP BY qid, token QUALIFY row_number() OVER (PARTITION BY qid ORDER BY count(*) DESC, token) = 1),")
    _GREEDY.append(f"h{_k + 1} AS (SELECT h.qid, h.g + 1 AS g FROM ({_live}) h JOIN s{_k} s USING (qid, token) WHERE token <> '<eos>'),")

#: For toxic documents, numbered as all are.
_TOXIC = "tox AS (SELECT tok.* FROM tok ASOF JOIN lay_g l ON tok.g >= l.lo WHERE l.doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)),"

_UNI = "u AS (SELECT shard, token, count(*) AS cnt FROM (SELECT shard, unnest(t) AS token FROM d UNION ALL SELECT shard, '<sep>' FROM d) GROUP BY ALL),"
_UNIT = f"(1::BIGINT << greatest(ceil(log2(prompt_cnt / {SUPPORT}.0)), 0)::INT)"
_CTXS = f"array_to_string(t[greatest(pos - {CTX}, 0) + 1:least(pos + n + {CTX}, doc_len)], ' ')"

SQL = {
    "corpus_stats": _sql("x AS (SELECT 1),", then="SELECT shard, count(*) AS doc_cnt, sum(len(t) + 1)::BIGINT AS tok_cnt, (sum(len(t) + 1) * 4)::BIGINT AS ds_size, (count(*) OVER ())::BIGINT AS num_shards, (sum(count(*)) OVER ())::BIGINT AS total_doc_cnt, (sum(sum(len(t) + 1)) OVER ())::BIGINT AS total_tok_cnt FROM d GROUP BY shard"),
    "unigram_counts": _sql(_UNI, then="SELECT * FROM u"),
    "unigram_logprob": _sql(_UNI, then="SELECT token, sum(cnt)::BIGINT AS cnt, round(ln(sum(cnt)) - ln(sum(sum(cnt)) OVER ()), 6) AS logprob FROM u GROUP BY token"),
    "unigram_ranges": _sql(_UNI, "r AS (SELECT *, (sum(cnt) OVER (PARTITION BY shard ORDER BY token = '<sep>', token))::BIGINT AS end_rank FROM u),", then="SELECT shard, token, end_rank - cnt AS start_rank, end_rank FROM r"),
    "find_positions": _match(then=f"SELECT qid, shard, doc_id, {_PTR} AS ptr FROM hit"),
    "ngram_count_batch": _match(then="SELECT q.qid, count(hit.qid) AS count, false AS approx FROM q LEFT JOIN hit USING (qid) GROUP BY ALL"),
    "find_by_shard": _match(then="SELECT qid, shard, count(*) AS cnt FROM hit GROUP BY ALL"),
    "find_with_hint": _sql("q AS (SELECT qid, ids[1:5] AS ids FROM b WHERE len(ids) >= 5),", _ext(), _LAYG, _HIT, then=f"SELECT qid, shard, {_PTR} AS ptr FROM hit"),
    "primitive_ntd": _match(more=_NTD, then="SELECT *, cont_cnt / prompt_cnt AS prob FROM nd"),
    "ntd_topk": _match(more=_NTD, then="SELECT *, cont_cnt / prompt_cnt AS prob, row_number() OVER (PARTITION BY qid ORDER BY cont_cnt DESC, token) AS rank FROM nd QUALIFY rank <= 20"),
    "ntd_approx": _match(
        more=_NTD + f"""un AS (SELECT *, {_UNIT} AS unit, (sum(cont_cnt) OVER (PARTITION BY qid ORDER BY token))::BIGINT AS e FROM nd),
pt AS (SELECT *, unnest(range(0, prompt_cnt, unit)) AS a FROM (SELECT DISTINCT qid, prompt_cnt, unit FROM un)),
mid AS (SELECT *, least(unit, prompt_cnt - a) AS w, a + least(unit, prompt_cnt - a) // 2 AS m FROM pt),""",
        then="SELECT un.qid, token, sum(w)::BIGINT AS cont_cnt, un.prompt_cnt, sum(w) / un.prompt_cnt AS prob, un.unit > 1 AS approx FROM un JOIN mid ON un.qid = mid.qid AND m >= e - un.cont_cnt AND m < e GROUP BY un.qid, token, un.prompt_cnt, un.unit",
    ),
    "primitive_prob": _sql(
        _grams(2, 3, 4, name="q0"), "q AS (SELECT qid, ids[:len(ids) - 1] AS ids, ids[len(ids)] AS cont FROM q0),", _ext(), _LAYG, _HIT,
        then="SELECT q.qid, count(hit.qid) AS prompt_cnt, count(*) FILTER (t.token = q.cont) AS cont_cnt, CASE WHEN count(hit.qid) > 0 THEN count(*) FILTER (t.token = q.cont) / count(hit.qid) ELSE -1.0::DOUBLE END AS prob FROM q LEFT JOIN hit USING (qid) LEFT JOIN tok t ON t.g = hit.g + hit.n GROUP BY q.qid",
    ),
    "infgram_prob": _sql(
        _PROMPT, _ext("p"), _BACK, _NONE,
        then="""SELECT pr.qid, count(*) AS prompt_cnt, count(*) FILTER (nxt = cont) AS cont_cnt, count(*) FILTER (nxt = cont) / count(*) AS prob, any_value(suffix_len) AS suffix_len FROM pr JOIN fit USING (qid) GROUP BY pr.qid
UNION ALL SELECT qid, (SELECT sum(n) FROM uni)::BIGINT, coalesce(n, 0)::BIGINT, coalesce(n, 0) / (SELECT sum(n) FROM uni), 0 FROM unknown LEFT JOIN uni ON token = cont""",
    ),
    "infgram_ntd": _sql(
        _PROMPT, _ext("p"), _BACK, _NONE,
        "nt AS (SELECT qid, coalesce(nxt, '<eos>') AS token, count(*) AS cont_cnt, any_value(suffix_len) AS suffix_len FROM fit GROUP BY 1, 2 UNION ALL SELECT qid, token, n, 0 FROM unknown, uni),",
        then="SELECT qid, token, cont_cnt, (sum(cont_cnt) OVER (PARTITION BY qid))::BIGINT AS prompt_cnt, cont_cnt / sum(cont_cnt) OVER (PARTITION BY qid) AS prob, suffix_len FROM nt",
    ),
    "cursor_advance": _sql(_ext("b"), then="SELECT k AS qid, n AS step, count(*) AS cnt FROM ext GROUP BY ALL"),
    "greedy_generate": _match(2, more="\n".join(_GREEDY), then=" UNION ALL ".join(f"SELECT qid, {k + 1}::BIGINT AS step, token, cont_cnt FROM s{k}" for k in range(STEPS))),
    "cnf_strict": _sql(_cnf(), _ext(), _LAYG, _HIT, _TERMS, then=f"SELECT qid, shard, doc_id, p FROM m WHERE clause = 0 AND {_NEAR % 1}"),
    "cnf_strict_three": _sql(_cnf(True), _ext(), _LAYG, _HIT, _TERMS, then=f"SELECT qid, shard, doc_id, p FROM m WHERE clause = 0 AND {_NEAR % 1} AND {_NEAR % 2}"),
    "cnf_terms_once": _sql(_cnf(), _ext(), _LAYG, _HIT, _TERMS, then="SELECT qid, clause, min(term)::BIGINT AS term, shard, doc_id, p FROM m GROUP BY qid, clause, shard, doc_id, p"),
    "longest_delims": _sql(_TAILS, _ext("p"), f"best AS (SELECT k, max(n) AS n FROM ext GROUP BY k), x AS (SELECT qid, ids, coalesce(n, 0) AS n FROM p LEFT JOIN best ON qid = k),",
        then=f"SELECT qid // 100000 AS qid, qid % 100000 AS l, coalesce(list_min(list_filter(range(1, n), lambda i: ids[i] IN ({', '.join(map(repr, DELIMS))}))), n) AS n FROM x"),
    "longest_bow": _sql(_TAILS, _ext("p"), f"best AS (SELECT k, max(n) AS n FROM ext GROUP BY k), x AS (SELECT qid, ids, coalesce(n, 0) AS n FROM p LEFT JOIN best ON qid = k),",
        then=f"SELECT qid // 100000 AS qid, qid % 100000 AS l, coalesce(list_max(list_filter(range(1, n + 1), lambda i: i = len(ids) OR ids[i + 1] IN ({', '.join(map(repr, BOW))}))), 0) AS n FROM x"),
    "cnf_compat": _sql(_cnf(), _ext(), _LAYG, _HIT, _TERMS, _COMPAT, then="SELECT * FROM ok"),
    "count_cnf": _sql(_cnf(), _ext(), _LAYG, _HIT, _TERMS, _COMPAT, then="SELECT x.qid, count(ok.qid) AS count, false AS approx FROM (SELECT DISTINCT qid // 10 AS qid FROM c) x LEFT JOIN ok USING (qid) GROUP BY x.qid"),
    "doc_by_ix": _sql("x AS (SELECT 1),", then=f"SELECT doc_ix, doc_id, doc_len, least(doc_len, {MAX_DISP})::BIGINT AS disp_len, 0::BIGINT AS needle_offset, array_to_string(t[1:{MAX_DISP}], ' ') AS tokens FROM lay"),
    "doc_by_ptr": _match(5, then=_shown("hit", f"qid, shard, {_PTR} AS ptr", str(_HALF), str(MAX_DISP - _HALF))),
    "doc_context2": _match(5, then=_shown("hit", f"qid, shard, {_PTR} AS ptr", str(CTX), f"n + {CTX}")),
    "search_docs_first_k": _match(then=_shown(f"(SELECT *, row_number() OVER (PARTITION BY qid ORDER BY shard, doc_start + pos) - 1 AS idx, count(*) OVER (PARTITION BY qid) AS cnt FROM hit QUALIFY idx < {K})", f"qid, idx, cnt, shard, {_PTR} AS ptr", str(_HALF), str(MAX_DISP - _HALF))),
    "search_docs_random": _match(
        more=f"""nr AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY shard, doc_start + pos) - 1 AS idx, count(*) OVER (PARTITION BY qid) AS cnt FROM hit),
dr AS (SELECT qid, ('0x' || substr(md5('7|' || qid || '|' || draw), 1, 12))::BIGINT % cnt AS idx FROM (SELECT DISTINCT qid, cnt FROM nr), (SELECT unnest(range({K})) AS draw)),""",
        then=_shown("nr JOIN dr USING (qid, idx)", f"qid, idx, cnt, shard, {_PTR} AS ptr", str(_HALF), str(MAX_DISP - _HALF)),
    ),
    "creativity": _sql(_TAILS, _ext("p"), then="SELECT p.qid // 100000 AS qid, p.qid % 100000 AS l, p.qid % 100000 + coalesce(max(e.n), 0) AS r FROM p LEFT JOIN ext e ON p.qid = e.k GROUP BY p.qid"),
    "attribution_spans": _sql(
        _TAILS, _ext("p"), _LAYG, _UNI,
        f"""best AS (SELECT k, max(n) AS n FROM ext GROUP BY k),
cn AS (SELECT k, n, count(*) AS cnt FROM ext JOIN best USING (k, n) GROUP BY ALL),
sp AS (SELECT k // 100000 AS qid, k % 100000 AS l, k % 100000 + n AS r, n AS length, cnt AS count, k FROM cn WHERE n >= {MIN_LEN} AND cnt <= {MAX_CNT}),
kept AS (SELECT * FROM sp QUALIFY r > coalesce(max(r) OVER (PARTITION BY qid ORDER BY l ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)),
lp AS (SELECT token, ln(sum(cnt)) - ln((SELECT sum(cnt) FROM u)) AS lp FROM u GROUP BY token),
ls AS (SELECT k, sum(lp) AS s FROM kept JOIN (SELECT qid AS k, unnest(range(len(ids))) AS i, unnest(ids) AS token FROM p) USING (k) JOIN lp USING (token) WHERE i < length GROUP BY k),
fit AS (SELECT e.k, string_agg(x.shard || ':' || (x.doc_start + 1 + e.g - x.base) * 4, ',' ORDER BY x.shard || ':' || (x.doc_start + 1 + e.g - x.base) * 4) AS ptrs FROM ext e JOIN kept ON e.k = kept.k AND e.n = length ASOF JOIN lay_g x ON e.g >= x.lo GROUP BY e.k),""",
        then="SELECT qid, l, r, length, count, round(s, 4) AS unigram_logprob_sum, ptrs FROM kept JOIN ls USING (k) JOIN fit USING (k)",
    ),
    "diff_longest": _sql(
        _TAILS, _LAYG, _TOXIC, _ext("p"), _ext("p", tok="tox", name="ext2"),
        "a AS (SELECT k, n, count(*) AS c FROM ext GROUP BY ALL), o AS (SELECT k, n, count(*) AS c FROM ext2 GROUP BY ALL), y AS (SELECT a.k, max(a.n) AS n FROM a LEFT JOIN o USING (k, n) WHERE a.c > coalesce(o.c, 0) GROUP BY a.k),",
        then="SELECT qid // 100000 AS qid, qid % 100000 AS l, coalesce(y.n, 0) AS n FROM p LEFT JOIN y ON p.qid = y.k",
    ),
    "diff_blocked": _match(
        5, more=f"ct AS (SELECT qid, shard, {_PTR} AS ptr, doc_ix, {_CTXS} AS tokens, doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1) AS bad FROM hit),",
        then="SELECT qid, shard, ptr, doc_ix, CASE WHEN blocked THEN '' ELSE tokens END AS tokens, blocked FROM (SELECT *, bool_or(bad) OVER (PARTITION BY qid, tokens) AS blocked FROM ct)",
    ),
    "slice_docs": _sql("x AS (SELECT 1),", then=f"SELECT shard, doc_id, doc_len FROM lay WHERE doc_ix < {BUDGET_DOCS} AND base + doc_len <= {BUDGET_TOKENS}"),
    "query_suite": _sql(
        """gr AS (SELECT doc_id, unnest(range(len(t))) AS pos, t FROM d), ng AS (SELECT doc_id, pos, n, array_to_string(t[pos + 1:pos + n], ' ') AS ids FROM gr, (VALUES (1), (2), (3), (4), (5), (6), (8), (10), (12), (16)) v(n) WHERE pos + n <= len(t)),
cn AS (SELECT n AS len, ids, count(*) AS cnt, min((doc_id, pos)) AS first FROM ng GROUP BY n, ids),
bu AS (SELECT *, CASE WHEN cnt <= 1 THEN 'ultra_rare' WHEN cnt <= 5 THEN 'rare' WHEN cnt <= 20 THEN 'low' WHEN cnt <= 100 THEN 'mid' WHEN cnt <= 1000 THEN 'high' ELSE 'very_high' END AS bucket FROM cn),""",
        then="SELECT bucket, len::BIGINT AS len, cnt, ids FROM bu QUALIFY row_number() OVER (PARTITION BY len, bucket ORDER BY first) <= 20",
    ),
    "verify_index": _match(
        more="vc AS (SELECT q.qid, count(hit.qid) AS left_cnt, count(hit.qid) FILTER (doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)) AS right_cnt FROM q LEFT JOIN hit USING (qid) GROUP BY q.qid),",
        then="SELECT * FROM vc WHERE left_cnt <> right_cnt",
    ),
}
