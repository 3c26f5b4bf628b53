"""The alignment of all pairs as DuckDB SQL: an independent version of operators.alignment for its oracles.

It takes the relations `rows` (cmp_id, side, block_index, text) and `anchors` (cmp_id, a_index, b_index). Longest common
subsequences are bit-parallel, with limbs of 120 bits; what is sequential (best first, groups that use up neighbours) is a
list_reduce over lists in that order. Scores are rounded half to even, as Python rounds.
"""

from __future__ import annotations

MARGIN, THRESHOLD, MOVE = "0.15::DOUBLE", "0.5::DOUBLE", "0.75::DOUBLE"


def common(source: str, p: str) -> str:
    """CTEs that end in {p}lcs (a, b, n) for the different texts a, b of the relation `source`."""
    return f"""
{p}t AS MATERIALIZED (SELECT DISTINCT a, b FROM {source} WHERE a <> '' AND b <> ''),
{p}ch AS (SELECT a, unnest(string_split(a, '')) AS c, generate_subscripts(string_split(a, ''), 1) - 1 AS i FROM (SELECT DISTINCT a FROM {p}t)),
{p}lm AS (SELECT a, c, i // 120 AS l, sum(1::HUGEINT << CAST(i % 120 AS INTEGER))::HUGEINT AS m FROM {p}ch GROUP BY ALL),
{p}gr AS (SELECT DISTINCT a, c, unnest(range(0, (length(a) - 1) // 120 + 1)) AS l FROM {p}ch),
{p}mk AS (SELECT a, c, list(coalesce(m, 0::HUGEINT) ORDER BY l) AS ms FROM {p}gr LEFT JOIN {p}lm USING (a, c, l) GROUP BY a, c),
{p}mp AS (SELECT a, map(list(c), list(ms)) AS mp FROM {p}mk GROUP BY a),
{p}q AS (SELECT a, b, mp, list_transform(range(0, (length(a) - 1) // 120 + 1), lambda l: CASE WHEN length(a) - 120 * l >= 120 THEN (1::HUGEINT << 120) - 1 ELSE (1::HUGEINT << CAST(length(a) - 120 * l AS INTEGER)) - 1 END) AS ones FROM {p}t JOIN {p}mp USING (a)),
{p}s AS (SELECT a, b, ones, list_filter(list_transform(string_split(b, ''), lambda c: mp[c]), lambda m: m IS NOT NULL) AS seq FROM {p}q),
{p}f AS (SELECT a, b, list_reduce(seq, lambda row, m: list_reduce(list_transform(range(1, len(row) + 1), lambda i: [row[i], row[i] & m[i], ones[i]]),
  lambda acc, z: acc[1:-2] || [((z[1] + z[2] + acc[-1]) & z[3]) | (z[1] - z[2]), (z[1] + z[2] + acc[-1]) >> 120], [0::HUGEINT])[1:-2], ones) AS fin FROM {p}s),
{p}lcs AS MATERIALIZED (SELECT a, b, CAST(length(a) - list_sum(list_transform(fin, lambda l: bit_count(l))) AS BIGINT) AS n FROM {p}f)"""


def ratio(a: str = "a", b: str = "b") -> str:
    return f"(CASE WHEN {a} = '' AND {b} = '' THEN 1.0::DOUBLE ELSE 2 * coalesce(n, 0)::DOUBLE / (length({a}) + length({b})) END)"


def bound(a: str, b: str) -> str:
    return f"(2 * least(length({a}), length({b}))::DOUBLE / greatest(length({a}) + length({b}), 1))"


def increasing(values: str) -> str:
    """A longest increasing subsequence of a list, by piles that each hold theirs."""
    below = "len(list_filter(t, lambda e: e[-1] < x[1][-1]))"
    return f"list_reduce(list_transform({values}, lambda j: [[j]]), lambda t, x: t[1:{below}] || [(CASE WHEN {below} > 0 THEN t[{below}] ELSE CAST([] AS INTEGER[]) END) || x[1]] || t[{below} + 2:], CAST([] AS INTEGER[][]))[-1]"


#: Blocks that no anchor holds, with their gap, and the scored and assigned pairs of gaps.
CANDIDATES = f"""
kept AS (SELECT cmp_id, unnest({increasing("list(b_index ORDER BY a_index)")}) AS b_index FROM anchors GROUP BY cmp_id),
bounds AS (SELECT cmp_id, list(a_index ORDER BY a_index) AS xs, list(b_index ORDER BY b_index) AS ys FROM kept JOIN anchors USING (cmp_id, b_index) GROUP BY cmp_id),
held AS (SELECT cmp_id, 'a' AS side, a_index AS block_index FROM anchors UNION ALL SELECT cmp_id, 'b', b_index FROM anchors),
opened AS MATERIALIZED (SELECT cmp_id, side, block_index, text, coalesce(len(list_filter(CASE side WHEN 'a' THEN xs ELSE ys END, lambda x: x < block_index)), 0) AS gap
  FROM (SELECT * FROM rows ANTI JOIN held USING (cmp_id, side, block_index)) LEFT JOIN bounds USING (cmp_id)),
sized AS (SELECT *, greatest(len(regexp_extract_all(text, '\\S+')), 1) AS w FROM opened),
met AS MATERIALIZED (SELECT x.cmp_id, x.gap, x.block_index AS i, y.block_index AS j, x.text AS a, y.text AS b FROM sized x JOIN sized y ON x.cmp_id = y.cmp_id AND x.gap = y.gap AND x.side = 'a' AND y.side = 'b'
  WHERE greatest(x.w, y.w) / least(x.w, y.w) <= 3.0 AND {bound("x.text", "y.text")} >= {THRESHOLD} - 1e-9),{common("met", "g")},
scored AS MATERIALIZED (SELECT cmp_id, gap, i, j, round_even({ratio()}, 4) AS score FROM met LEFT JOIN glcs USING (a, b) WHERE {ratio()} >= {THRESHOLD}),
taken AS (SELECT cmp_id, unnest(list_reduce(list([[i, j]] ORDER BY score DESC, i, j), lambda acc, x: CASE WHEN len(list_filter(acc, lambda e: e[1] = x[1][1] OR e[2] = x[1][2])) > 0 THEN acc ELSE acc || x END, CAST([] AS INTEGER[][]))) AS ij FROM scored GROUP BY cmp_id, gap),
paired AS MATERIALIZED (SELECT scored.cmp_id, i, j, score FROM taken JOIN scored ON taken.cmp_id = scored.cmp_id AND i = ij[1] AND j = ij[2])"""


def chosen(windows: str, p: str) -> str:
    """CTE {p}out (cmp_id, one, s, e, score): for each block in turn its best window of blocks that are still free. windows:
    cmp_id, one, s, e, score, first, second (order among equal scores)."""
    free = "len(list_filter(acc, lambda q: q[2] <= w[3] AND w[2] <= q[3])) = 0"
    return f"""
{p}by AS (SELECT cmp_id, one, list([one, s, e] ORDER BY score DESC, first, second) AS ws FROM {windows} GROUP BY cmp_id, one),
{p}all AS (SELECT cmp_id, unnest(list_reduce(list(ws ORDER BY one), lambda acc, x: acc || list_filter(x, lambda w: {free})[1:1], CAST([] AS INTEGER[][]))) AS w FROM {p}by GROUP BY cmp_id),
{p}out AS MATERIALIZED (SELECT v.cmp_id, v.one, v.s, v.e, v.score FROM {p}all k JOIN {windows} v ON v.cmp_id = k.cmp_id AND v.one = w[1] AND v.s = w[2] AND v.e = w[3])"""


def grown(pairs: str, side: str, free: str, p: str) -> str:
    """Groups around a pair's partner. pairs: cmp_id, one, partner, score; side: that of the partners; free: cmp_id, fs."""
    other = "a" if side == "b" else "b"
    return f"""
{p}w AS (SELECT q.cmp_id, one, q.score AS alone, partner - x AS s, partner + y AS e, x AS first, y AS second, o.ts[one + 1] AS a, array_to_string(m.ts[partner - x + 1:partner + y + 1], ' ') AS b
  FROM {pairs} q JOIN {free} USING (cmp_id) JOIN texts o ON o.cmp_id = q.cmp_id AND o.side = '{other}' JOIN texts m ON m.cmp_id = q.cmp_id AND m.side = '{side}', range(0, 4) t1(x), range(0, 4) t2(y)
  WHERE x + y BETWEEN 1 AND 3 AND q.score + {MARGIN} < 1.0 AND len(list_filter(range(partner - x, partner + y + 1), lambda k: k = partner OR list_contains(fs, k))) = x + y + 1),
{p}n AS MATERIALIZED (SELECT * FROM {p}w WHERE {bound("a", "b")} + 1e-4 >= greatest({THRESHOLD}, alone + {MARGIN})),{common(f"{p}n", p)},
{p}v AS MATERIALIZED (SELECT cmp_id, one, CAST(s AS INTEGER) AS s, CAST(e AS INTEGER) AS e, first, second, round_even({ratio()}, 4) AS score FROM {p}n LEFT JOIN {p}lcs USING (a, b) WHERE round_even({ratio()}, 4) >= {THRESHOLD} AND round_even({ratio()}, 4) > alone + {MARGIN}),{chosen(f"{p}v", p)}"""


def gathered(ones: str, side: str, free: str, p: str) -> str:
    """Unmatched blocks that resemble two to four free neighbours. ones: cmp_id, one; free: cmp_id, fs."""
    other = "a" if side == "b" else "b"
    return f"""
{p}w AS (SELECT cmp_id, s, s + y AS e, array_to_string(ts[s + 1:s + y + 1], ' ') AS b FROM (SELECT cmp_id, fs, unnest(fs) AS s FROM {free}) JOIN texts USING (cmp_id), range(1, 4) r(y)
  WHERE side = '{side}' AND len(list_filter(range(s, s + y + 1), lambda k: list_contains(fs, k))) = y + 1),
{p}x AS MATERIALIZED (SELECT q.cmp_id, one, s, e, o.ts[one + 1] AS a, b FROM {ones} q JOIN {p}w w ON w.cmp_id = q.cmp_id JOIN texts o ON o.cmp_id = q.cmp_id AND o.side = '{other}' WHERE {bound("o.ts[one + 1]", "b")} + 1e-4 >= {THRESHOLD}),
{p}k AS MATERIALIZED (SELECT DISTINCT z.cmp_id, one, z.a, k, m.ts[k + 1] AS b FROM (SELECT cmp_id, one, a, unnest(range(s, e + 1)) AS k FROM {p}x) z JOIN texts m ON m.cmp_id = z.cmp_id AND m.side = '{side}'),{common(f"{p}k", f"{p}1")},
{p}h AS (SELECT cmp_id, one, k, coalesce(n, 0) AS n, round_even({ratio()}, 4) AS alone FROM {p}k LEFT JOIN {p}1lcs USING (a, b)),
{p}u AS (SELECT x.cmp_id, x.one, x.s, x.e, x.a, x.b, max(alone) AS alone, sum(h.n) AS parts FROM {p}x x JOIN {p}h h ON h.cmp_id = x.cmp_id AND h.one = x.one AND k BETWEEN s AND e GROUP BY ALL),
{p}n AS MATERIALIZED (SELECT * FROM {p}u WHERE least({bound("a", "b")}, 2 * (parts + e - s)::DOUBLE / (length(a) + length(b))) + 1e-4 >= greatest({THRESHOLD}, alone + {MARGIN})),{common(f"{p}n", f"{p}2")},
{p}v AS MATERIALIZED (SELECT cmp_id, one, CAST(s AS INTEGER) AS s, CAST(e AS INTEGER) AS e, s AS first, e AS second, round_even({ratio()}, 4) AS score FROM {p}n LEFT JOIN {p}2lcs USING (a, b) WHERE round_even({ratio()}, 4) >= {THRESHOLD} AND round_even({ratio()}, 4) > alone + {MARGIN}),{chosen(f"{p}v", p)}"""


def _without(source: str, gone: str, p: str) -> str:
    """{p} (cmp_id, fs): the free blocks of `source` without the windows of `gone`."""
    return f"""
{p}g AS (SELECT cmp_id, list([s, e]) AS ws FROM {gone} GROUP BY cmp_id),
{p} AS MATERIALIZED (SELECT cmp_id, list_filter(fs, lambda k: len(list_filter(coalesce(ws, CAST([] AS INTEGER[][])), lambda w: w[1] <= k AND k <= w[2])) = 0) AS fs FROM {source} LEFT JOIN {p}g USING (cmp_id))"""


#: Ends in aligned: cmp_id, position, relation, xs, ys (block numbers of both sides), similarity, move_distance.
ALIGNED = f"""{CANDIDATES},
texts AS MATERIALIZED (SELECT cmp_id, side, list(text ORDER BY block_index) AS ts FROM rows GROUP BY ALL),
every AS (SELECT DISTINCT cmp_id FROM rows),
opena AS (SELECT cmp_id, list(block_index ORDER BY block_index) AS fs FROM (SELECT cmp_id, block_index FROM opened WHERE side = 'a') o ANTI JOIN paired ON paired.cmp_id = o.cmp_id AND i = block_index GROUP BY cmp_id),
openb AS (SELECT cmp_id, list(block_index ORDER BY block_index) AS fs FROM (SELECT cmp_id, block_index FROM opened WHERE side = 'b') o ANTI JOIN paired ON paired.cmp_id = o.cmp_id AND j = block_index GROUP BY cmp_id),
free_a AS MATERIALIZED (SELECT cmp_id, coalesce(fs, CAST([] AS INTEGER[])) AS fs FROM every LEFT JOIN opena USING (cmp_id)),
free_b AS MATERIALIZED (SELECT cmp_id, coalesce(fs, CAST([] AS INTEGER[])) AS fs FROM every LEFT JOIN openb USING (cmp_id)),
p_s AS (SELECT cmp_id, i AS one, j AS partner, score FROM paired),{grown("p_s", "b", "free_b", "sp")},{_without("free_b", "spout", "free_b1")},
p_m AS (SELECT cmp_id, j AS one, i AS partner, score FROM paired ANTI JOIN spout ON spout.cmp_id = paired.cmp_id AND one = i),{grown("p_m", "a", "free_a", "mg")},{_without("free_a", "mgout", "free_a1")},
ones_a AS (SELECT cmp_id, unnest(fs) AS one FROM free_a1),{gathered("ones_a", "b", "free_b1", "os")},{_without("free_b1", "osout", "free_b2")},
own_a AS (SELECT cmp_id, one AS s, one AS e FROM osout),{_without("free_a1", "own_a", "free_a2")},
ones_b AS (SELECT cmp_id, unnest(fs) AS one FROM free_b2),{gathered("ones_b", "a", "free_a2", "om")},{_without("free_a2", "omout", "free_a3")},
own_b AS (SELECT cmp_id, one AS s, one AS e FROM omout),{_without("free_b2", "own_b", "free_b3")},
matched AS (SELECT cmp_id, a_index AS i, b_index AS j, 1.0::DOUBLE AS score FROM anchors UNION ALL SELECT cmp_id, partner, one, score FROM p_m ANTI JOIN mgout USING (cmp_id, one)),
still AS (SELECT cmp_id, {increasing("list(j ORDER BY i)")} AS js FROM matched GROUP BY cmp_id),
relations AS (
  SELECT cmp_id, 'MATCHED' AS relation, [i] AS xs, [j] AS ys, score AS similarity, CASE WHEN NOT list_contains(js, j) AND score >= {MOVE} THEN j - i END AS move_distance FROM matched JOIN still USING (cmp_id)
  UNION ALL SELECT cmp_id, 'SPLIT', [one], CAST(range(s, e + 1) AS INTEGER[]), score, NULL FROM (SELECT * FROM spout UNION ALL SELECT * FROM osout)
  UNION ALL SELECT cmp_id, 'MERGED', CAST(range(s, e + 1) AS INTEGER[]), [one], score, NULL FROM (SELECT * FROM mgout UNION ALL SELECT * FROM omout)
  UNION ALL SELECT cmp_id, 'DELETED', [k], CAST([] AS INTEGER[]), 0.0, NULL FROM (SELECT cmp_id, unnest(fs) AS k FROM free_a3)
  UNION ALL SELECT cmp_id, 'INSERTED', CAST([] AS INTEGER[]), [k], 0.0, NULL FROM (SELECT cmp_id, unnest(fs) AS k FROM free_b3)),
placed AS (SELECT *, row_number() OVER (PARTITION BY cmp_id ORDER BY ys[1], coalesce(xs[1], 0)) AS place, coalesce(xs[1], -1) AS front FROM relations WHERE len(ys) > 0),
deleted AS (SELECT d.cmp_id, d.xs[1] AS k, min(place) AS place FROM relations d LEFT JOIN placed p ON p.cmp_id = d.cmp_id AND front > d.xs[1] WHERE d.relation = 'DELETED' GROUP BY ALL),
ordered AS (SELECT cmp_id, relation, xs, ys, similarity, move_distance, place, 1 AS after, 0 AS k FROM placed
  UNION ALL SELECT cmp_id, 'DELETED', [k], CAST([] AS INTEGER[]), 0.0, NULL, coalesce(place, 1000000000), 0, k FROM deleted),
aligned AS MATERIALIZED (SELECT cmp_id, CAST(row_number() OVER (PARTITION BY cmp_id ORDER BY place, after, k) AS INTEGER) AS position, relation, xs, ys, similarity, CAST(move_distance AS INTEGER) AS move_distance FROM ordered)"""

#: Ends in listed: a row for each difference block, without its tokens.
LISTED = f"""{ALIGNED},
members AS (SELECT *, unnest(range(1, CASE relation WHEN 'SPLIT' THEN len(ys) WHEN 'MERGED' THEN len(xs) ELSE 1 END + 1)) AS nth FROM aligned),
numbered AS (SELECT cmp_id, position, nth, relation, move_distance, xs[CASE relation WHEN 'MERGED' THEN nth ELSE 1 END] AS i, ys[CASE relation WHEN 'SPLIT' THEN nth ELSE 1 END] AS j,
  CAST(row_number() OVER w AS INTEGER) AS seq, sum(CASE WHEN relation IN ('SPLIT', 'MERGED') AND nth = 1 THEN 1 ELSE 0 END) OVER w AS grp FROM members WINDOW w AS (PARTITION BY cmp_id ORDER BY position, nth)),
listed AS MATERIALIZED (SELECT n.cmp_id, seq, i, j, n.move_distance, CASE WHEN relation IN ('SPLIT', 'MERGED') THEN format('grp_{{:04d}}', CAST(grp AS BIGINT)) ELSE format('dbk_{{:04d}}', seq) END AS key,
  CASE WHEN relation <> 'MATCHED' THEN relation WHEN move_distance IS NOT NULL THEN 'MOVED' WHEN x.ts[i + 1] = y.ts[j + 1] THEN 'UNCHANGED' ELSE 'MODIFIED' END AS status
  FROM numbered n LEFT JOIN texts x ON x.cmp_id = n.cmp_id AND x.side = 'a' LEFT JOIN texts y ON y.cmp_id = n.cmp_id AND y.side = 'b')"""
