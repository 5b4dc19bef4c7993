"""Reusable DuckDB/ANSI SQL fragments for the oracle side of the registry.

Each function returns CTE text (``name AS (...)``) so oracle queries read as
the same plan the DataFrame code builds. The views ``embeddings``,
``documents``, ``events``, ... are registered by the checker.
"""

from __future__ import annotations


def u_sql(seed: int, salt: str, id_expr: str) -> str:
    """Uniform [0, 1) from md5, same as :func:`tidemark.functions.hashing.uniform`."""
    return (f"(('0x' || substr(md5(concat_ws(':', '{seed}', '{salt}', ({id_expr})::VARCHAR)), 1, 8))"
            f"::UBIGINT / 4294967296.0)")


def hkey_sql(seed: int, salt: str, id_expr: str) -> str:
    return f"md5(concat_ws(':', '{seed}', '{salt}', ({id_expr})::VARCHAR))"


def norm_sql(e: str) -> str:
    return f"sqrt(list_sum(list_transform({e}, lambda y: y * y)))"


def normalize_sql(e: str) -> str:
    return (f"CASE WHEN {norm_sql(e)} > 0 THEN list_transform({e}, lambda x: x / {norm_sql(e)}) "
            f"ELSE {e} END")


def emb_cte(name: str = "emb", normalize: bool = True) -> str:
    """A1 + A2."""
    e = "embedding::DOUBLE[]"
    body = normalize_sql(e) if normalize else e
    return (f"{name} AS (SELECT vec_id::BIGINT AS id, {body} AS embedding, label::INTEGER AS label "
            f"FROM embeddings)")


def dist_sql(a: str, b: str, metric: str = "half_cosine") -> str:
    # a zero vector has cosine 0 with everything (as in the block kernel)
    cos = f"coalesce(list_dot_product({a}, {b}) / NULLIF({norm_sql(a)} * {norm_sql(b)}, 0), 0.0)"
    if metric == "half_cosine":
        return f"((1 - {cos}) / 2)"
    if metric == "cosine":
        return f"(1 - {cos})"
    if metric == "sql2":
        return f"list_sum(list_transform(list_zip({a}, {b}), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"
    if metric == "l2":
        return f"sqrt({dist_sql(a, b, 'sql2')})"
    raise ValueError(metric)


def sample_cte(name: str, src: str, seed: int, salt: str, frac: float | None = None,
               n_errors: int | None = None) -> str:
    """Rows first in seeded hash order with ``hrank`` and first free id ``nid``."""
    m = f"{int(n_errors)}" if n_errors is not None else f"ceil(count(*) * {float(frac)!r})::BIGINT"
    return f"""{name}_m AS (SELECT {m} AS m, coalesce(max(id) + 1, 0)::BIGINT AS nid FROM {src}),
{name}_r AS (SELECT s.*, row_number() OVER (ORDER BY {hkey_sql(seed, salt, 's.id')}, s.id) AS hrank FROM {src} s),
{name} AS (SELECT r.*, {name}_m.nid + r.hrank - 1 AS new_id FROM {name}_r r, {name}_m WHERE r.hrank <= {name}_m.m)"""


def vector_noise_sql(e: str, rid: str, seed: int = 42, scale: float = 0.05, salt: str = "k1") -> str:
    noisy = (f"list_transform({e}, lambda x, i: x + {scale!r} * ((('0x' || substr(md5(concat_ws(':', "
             f"'{seed}', '{salt}', ({rid})::VARCHAR, (i - 1)::VARCHAR)), 1, 8))::UBIGINT / 4294967296.0) - 0.5))")
    return noisy


def k1_ctes(src: str = "emb", out: str = "k1c", truth: str = "k1t", frac: float = 0.1,
            seed: int = 42) -> str:
    """K1 with vector noise: contaminated table ``out`` and truth ``truth``."""
    return f"""{sample_cte('k1s', src, seed, 'k1', frac)},
k1n AS (SELECT k1s.new_id AS nid2, {vector_noise_sql('k1s.embedding', 'k1s.id', seed)} AS e, k1s.label FROM k1s),
{out} AS (SELECT id, embedding, label FROM {src}
          UNION ALL SELECT nid2 AS id, {normalize_sql('e')} AS embedding, label FROM k1n),
{truth} AS (SELECT 'near_duplicate' AS issue_type, id, new_id AS id2 FROM k1s)"""


def pairs_cte(name: str, src: str, metric: str = "half_cosine") -> str:
    return (f"{name} AS (SELECT a.id AS i, b.id AS j, {dist_sql('a.embedding', 'b.embedding', metric)} AS dist "
            f"FROM {src} a JOIN {src} b ON a.id < b.id)")


def ranked_pairs_cte(name: str, pairs: str) -> str:
    return (f"{name} AS (SELECT row_number() OVER (ORDER BY round(dist, 9), i, j) AS rank, i, j, dist AS score "
            f"FROM {pairs})")


def pair_hits_cte(name: str, ranked: str, truth: str) -> str:
    return (f"{name} AS (SELECT r.rank, CASE WHEN t.a IS NULL THEN 0 ELSE 1 END AS hit FROM {ranked} r "
            f"LEFT JOIN (SELECT DISTINCT least(id, id2) AS a, greatest(id, id2) AS b FROM {truth}) t "
            f"ON least(r.i, r.j) = t.a AND greatest(r.i, r.j) = t.b)")


def id_hits_cte(name: str, ranked: str, truth: str) -> str:
    return (f"{name} AS (SELECT r.rank, CASE WHEN t.id IS NULL THEN 0 ELSE 1 END AS hit FROM {ranked} r "
            f"LEFT JOIN (SELECT DISTINCT id FROM {truth}) t ON r.id = t.id)")


def long_cte(name: str, src: str = "emb") -> str:
    """``(id, dim, x)`` long form of the embedding."""
    return (f"{name} AS (SELECT id, generate_subscripts(embedding, 1) - 1 AS dim, "
            f"unnest(embedding) AS x FROM {src})")


def knn_cte(name: str, src: str, k: int, metric: str, base: str | None = None,
            exclude_self: bool = True) -> str:
    base = base or src
    cond = "a.id <> b.id" if exclude_self else "TRUE"
    return f"""{name}_d AS (SELECT a.id AS q, b.id AS nbr, {dist_sql('a.embedding', 'b.embedding', metric)} AS dist
                FROM {src} a JOIN {base} b ON {cond}),
{name}_r AS (SELECT q, nbr, dist, row_number() OVER (PARTITION BY q ORDER BY round(dist, 9), nbr) AS nn_rank
             FROM {name}_d),
{name} AS (SELECT q, nbr, dist, nn_rank::INTEGER AS nn_rank FROM {name}_r WHERE nn_rank <= {k})"""


def label_ratio_ctes(src: str = "emb", out: str = "lr") -> str:
    """J1c scores ``(id, score)``."""
    return f"""{out}_p AS (SELECT a.id, a.label = b.label AS same, {dist_sql('a.embedding', 'b.embedding')} AS dist
               FROM {src} a JOIN {src} b ON a.id <> b.id),
{out}_n AS (SELECT e.id, min(CASE WHEN p.same THEN p.dist END) AS d_same,
                   min(CASE WHEN NOT p.same THEN p.dist END) AS d_other
            FROM {src} e LEFT JOIN {out}_p p ON p.id = e.id GROUP BY e.id),
{out} AS (SELECT id, CASE WHEN d_other IS NULL THEN 1.0
                          WHEN coalesce(d_same, 1.0) * coalesce(d_same, 1.0) + d_other * d_other = 0 THEN 0.5
                          ELSE d_other * d_other / (coalesce(d_same, 1.0) * coalesce(d_same, 1.0) + d_other * d_other)
                     END AS score FROM {out}_n)"""


def label_error_ctes(src: str = "emb", out: str = "k5c", truth: str = "k5t", frac: float = 0.1,
                     seed: int = 42, per_class: bool = False, pool: str | None = None) -> str:
    """K5 / K6: flipped labels ``out`` and truth ``truth``; ``pool`` restricts
    the sampled rows (K7 samples original ids only)."""
    salt = "k6" if per_class else "k5"
    if pool is not None:
        pool_cte = f"{salt}_pool AS (SELECT * FROM {src} WHERE id IN (SELECT id FROM {pool}))"
        inner = label_error_ctes(f"{salt}_pool", out + "_inner", truth, frac, seed, per_class)
        return (f"{pool_cte}, {salt}_nc0 AS (SELECT (max(label) + 1)::INTEGER AS ncls FROM {src}), "
                + inner.replace(f"{salt}_nc AS (SELECT (max(label) + 1)::INTEGER AS ncls FROM {salt}_pool)",
                                f"{salt}_nc AS (SELECT ncls FROM {salt}_nc0)")
                + f""",
{out} AS (SELECT e.id, e.embedding, coalesce(f.new_label, e.label) AS label FROM {src} e LEFT JOIN {salt}_f f USING (id))""")
    ncls = f"{salt}_nc AS (SELECT (max(label) + 1)::INTEGER AS ncls FROM {src})"
    if per_class:
        pick = f"""{salt}_r AS (SELECT id, label, row_number() OVER (PARTITION BY label ORDER BY {hkey_sql(seed, salt, 'id')}, id) AS cr,
                        count(*) OVER (PARTITION BY label) AS nc FROM {src}),
{salt}_s AS (SELECT id, label FROM {salt}_r WHERE cr <= ceil(nc * {float(frac)!r}))"""
    else:
        pick = f"""{sample_cte(salt + '_x', src, seed, salt, frac)},
{salt}_s AS (SELECT id, label FROM {salt}_x)"""
    return f"""{ncls}, {pick},
{salt}_f AS (SELECT s.id, ((s.label + 1 + floor({u_sql(seed, salt + ':new', 's.id')} * (nc.ncls - 1)))::BIGINT % nc.ncls)::INTEGER AS new_label
             FROM {salt}_s s, {salt}_nc nc),
{out} AS (SELECT e.id, e.embedding, coalesce(f.new_label, e.label) AS label FROM {src} e LEFT JOIN {salt}_f f USING (id)),
{truth} AS (SELECT 'label_error' AS issue_type, id, NULL::BIGINT AS id2 FROM {salt}_f)"""


def bow_cte(name: str, src: str, id_col: str, text_col: str, dims: int = 64) -> str:
    """Hashed bag of words, same as :func:`tidemark.functions.vectors.hashed_bow`."""
    return f"""{name}_t AS (SELECT {id_col} AS id, unnest(regexp_split_to_array(lower({text_col}), '\\s+')) AS tok FROM {src}),
{name}_c AS (SELECT id, (('0x' || substr(md5(tok), 1, 8))::UBIGINT % {dims})::BIGINT AS b, count(*)::DOUBLE AS c
             FROM {name}_t WHERE length(tok) > 0 GROUP BY id, b),
{name} AS (SELECT d.id, list(coalesce(c.c, 0.0) ORDER BY g.b) AS embedding
           FROM (SELECT {id_col} AS id FROM {src}) d CROSS JOIN (SELECT range AS b FROM range({dims})) g
           LEFT JOIN {name}_c c ON c.id = d.id AND c.b = g.b GROUP BY d.id)"""


def destroy_ctes(src: str = "emb", out: str = "k3c", truth: str = "k3t", frac: float = 0.1,
                 seed: int = 42, levels: float = 2.0, width: int = 2) -> str:
    """K3 with the vector destruction: smoothed, quantised, renormalised copies
    replace the sampled rows under the class max(label) + 1."""
    v = "k3s.embedding"
    lo = f"greatest(i - 1 - {width}, 0)"
    hi = f"least(i - 1 + {width}, len({v}) - 1)"
    smooth = f"list_transform({v}, lambda x, i: list_sum(list_slice({v}, {lo} + 1, {hi} + 1)) / ({hi} - {lo} + 1))"
    return f"""{sample_cte('k3s', src, seed, 'k3', frac)},
k3m AS (SELECT k3s.new_id AS nid2, {smooth} AS sm FROM k3s),
k3p AS (SELECT nid2, list_transform(sm, lambda y: coalesce(round(y / NULLIF(sqrt(list_sum(list_transform(sm, lambda z: z * z)) / len(sm)), 0) * {levels!r}) / {levels!r}, 0.0)) AS e FROM k3m),
k3n AS (SELECT (max(label) + 1)::INTEGER AS ncls FROM {src}),
{out} AS (SELECT id, embedding, label FROM {src} WHERE id NOT IN (SELECT id FROM k3s)
          UNION ALL SELECT nid2 AS id, {normalize_sql('e')} AS embedding, ncls AS label FROM k3p, k3n),
{truth} AS (SELECT 'off_topic' AS issue_type, new_id AS id, NULL::BIGINT AS id2 FROM k3s)"""


def k1_on(src: str, out: str, truth: str, frac: float, seed: int = 42) -> str:
    """K1 on an arbitrary source CTE (names prefixed by ``out``)."""
    return (k1_ctes(src, out, truth, frac, seed)
            .replace("k1s", f"{out}_s").replace("k1n", f"{out}_n"))
