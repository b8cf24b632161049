"""ANSI SQL (DuckDB) that must give the same rows as :mod:`catalog.queries`.

Written independently of the library: brute-force joins and windows where the
library avoids them.
"""

from __future__ import annotations

import math

from likeness.sources.fixtures import CUST, CUST_CONTEXTS, LINE, LINE_CONTEXTS, NUM3, ORD, PART

CUST_SQL = """
SELECT c_custkey AS row_id, r_name AS region, n_name AS nation, c_mktsegment AS segment,
       CAST(CAST(floor(c_acctbal / 2000) AS BIGINT) AS VARCHAR) AS bal
FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"""
MISSING_SQL = "SELECT row_id, region, nation, CASE WHEN row_id % 17 = 0 THEN '' ELSE segment END AS segment, bal FROM cust"
LINE_ID = "concat_ws('|', l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_shipdate AS DATE))"
LINE_SQL = f"""
SELECT {LINE_ID} AS row_id, l_returnflag AS flag, l_linestatus AS status,
       CAST(CAST(round(l_discount * 100) AS BIGINT) AS VARCHAR) AS disc,
       CAST(CAST(round(l_tax * 100) AS BIGINT) AS VARCHAR) AS tax,
       CAST(year(l_shipdate) AS VARCHAR) AS ship_year, CAST(quarter(l_shipdate) AS VARCHAR) AS ship_qtr,
       CASE WHEN quarter(l_shipdate) <= 2 THEN '1' ELSE '2' END AS ship_half
FROM lineitem"""
PART_SQL = """
SELECT p_partkey AS row_id, p_brand AS brand, p_type AS type,
       CAST(CAST(floor(p_size / 10) AS BIGINT) AS VARCHAR) AS size_band,
       CAST(CAST(floor(p_retailprice / 20) AS BIGINT) AS VARCHAR) AS price_band
FROM part"""
ORD_SQL = """
SELECT o_orderkey AS row_id, o_orderstatus AS status, o_orderpriority AS priority,
       CAST(year(o_orderdate) AS VARCHAR) AS year, CAST(month(o_orderdate) AS VARCHAR) AS month
FROM orders"""
NUM3_SQL = f"SELECT {LINE_ID} AS row_id, l_quantity, l_extendedprice, l_discount FROM lineitem"

EMPTY = "CAST([] AS VARCHAR[])"


def build(ctes: list[tuple[str, str]], final: str) -> str:
    return "WITH " + ",\n".join(f"{name} AS ({body})" for name, body in ctes) + "\n" + final


CUST_CTE, MISSING_CTE, LINE_CTE = ("cust", CUST_SQL), ("cust_missing", MISSING_SQL), ("line", LINE_SQL)
PART_CTE, ORD_CTE, NUM3_CTE = ("part_f", PART_SQL), ("ord_f", ORD_SQL), ("num3", NUM3_SQL)


def h(seed, name: str, id_expr: str) -> str:
    return f"md5('{seed}|{name}|' || CAST({id_expr} AS VARCHAR))"


def u(seed, name: str, id_expr: str) -> str:
    return f"((CAST(('0x' || substr({h(seed, name, id_expr)}, 1, 13)) AS BIGINT) + 0.5) / 4503599627370496.0)"


def z(seed, name: str, id_expr: str) -> str:
    return f"(sqrt(-2.0 * ln({u(seed, name + '#r', id_expr)})) * cos({2.0 * math.pi!r} * {u(seed, name + '#a', id_expr)}))"


def permuted(src: str, cols: list[str], column: str, seed: str = "s") -> list[tuple[str, str]]:
    kept = ", ".join(f"a.{c}" if c != column else f"b.{c}" for c in cols)
    return [
        (f"{src}_to", f"SELECT *, row_number() OVER (ORDER BY {h(seed, 'to', 'row_id')}, row_id) AS rk FROM {src}"),
        (f"{src}_from", f"SELECT {column}, row_number() OVER (ORDER BY {h(seed, 'from', 'row_id')}, row_id) AS rk FROM {src}"),
        (f"{src}_perm", f"SELECT a.row_id, {kept} FROM {src}_to a JOIN {src}_from b ON a.rk = b.rk"),
    ]


def counts(src: str, cols: list[str], by: str = "") -> str:
    lead = f"{by}, " if by else ""
    return " UNION ALL ".join(
        f"SELECT {lead}'{c}' AS col, {c} AS token, count(*) AS n FROM {src} WHERE {c} IS NOT NULL GROUP BY {lead}{c}"
        for c in cols
    )


def cdf(name: str, src: str, keys: str) -> tuple[str, str]:
    """Token intervals [lo, hi) per key, tokens in md5 order."""
    return (
        name,
        f"""SELECT {keys}, token, CAST(hi - n AS BIGINT) AS lo, hi, total FROM (
            SELECT *, CAST(sum(n) OVER (PARTITION BY {keys} ORDER BY md5(token), token) AS BIGINT) AS hi,
                   CAST(sum(n) OVER (PARTITION BY {keys}) AS BIGINT) AS total FROM {src}) q""",
    )


def index(u_expr: str, total: str) -> str:
    return f"CAST(least(floor({u_expr} * {total}), {total} - 1) AS BIGINT)"


def baseline(src: str, cols: list[str], seed: int, out: str, counts_sql: str | None = None) -> list[tuple[str, str]]:
    # One column at a time keeps DuckDB's range joins small.
    parts = [
        (
            f"{out}_{c}",
            f"""SELECT q.row_id, t.token AS {c} FROM
                (SELECT row_id, {index(u(seed, c, 'row_id'), 'total')} AS idx FROM {out}_ids,
                 (SELECT max(total) AS total FROM {out}_cdf WHERE col = '{c}') m) q
                JOIN (SELECT * FROM {out}_cdf WHERE col = '{c}') t ON q.idx >= t.lo AND q.idx < t.hi""",
        )
        for c in cols
    ]
    joined = f"SELECT r.row_id, {', '.join(f'{out}_{c}.{c}' for c in cols)} FROM {out}_ids r " + " ".join(
        f"JOIN {out}_{c} ON r.row_id = {out}_{c}.row_id" for c in cols
    )
    return [
        (f"{out}_n", counts_sql or counts(src, cols)),
        cdf(f"{out}_cdf", f"{out}_n", "col"),
        (f"{out}_ids", f"SELECT range AS row_id FROM range((SELECT count(*) FROM {src}))"),
        *parts,
        (out, joined),
    ]


def union(datasets: dict[str, str], cols: list[str], key: bool = True) -> str:
    lead = "CAST(row_id AS VARCHAR) AS row_id, " if key else ""
    return " UNION ALL ".join(
        f"SELECT '{name}' AS dataset, {lead}{', '.join(cols)} FROM {src}" for name, src in datasets.items()
    )


def cells(src: str, cols: list[str], contexts: dict, keep: str = "") -> str:
    lead = f"{keep}, " if keep else ""
    out = []
    for i, c in enumerate(cols):
        ctx = contexts.get(c, [])
        leaf = f"[{', '.join(ctx)}]" if ctx else EMPTY
        out.append(f"SELECT {lead}{i} AS target, '{c}' AS name, {leaf} AS leaf, {c} AS token FROM {src}")
    return " UNION ALL ".join(out)


def model(p: str, src: str, cols: list[str], contexts: dict) -> list[tuple[str, str]]:
    return [
        (f"{p}_cnt", f"SELECT target, name, leaf, token, count(*) AS n FROM ({cells(src, cols, contexts)}) q GROUP BY ALL"),
        (
            f"{p}_tok",
            f"SELECT * FROM {p}_cnt UNION ALL SELECT target, name, {EMPTY}, token, CAST(sum(n) AS BIGINT) FROM {p}_cnt "
            "WHERE len(leaf) > 0 GROUP BY target, name, token",
        ),
        (
            f"{p}_leaf",
            f"""SELECT target, leaf, CAST(sum(n) AS BIGINT) AS n, max(n) AS n_max, count(*) AS k,
                sum(CAST(n AS DOUBLE) * n) / (CAST(sum(n) AS DOUBLE) * CAST(sum(n) AS DOUBLE)) AS sq
                FROM {p}_tok GROUP BY target, leaf""",
        ),
    ]


def scored(out: str, cells_name: str, p: str, keep: str = "", eps: float = 0.0) -> list[tuple[str, str]]:
    lead = "".join(f"c.{k.strip()}, " for k in keep.split(",")) if keep else ""
    lead2 = f"{keep}, " if keep else ""
    return [
        (
            f"{out}_s",
            f"""SELECT {lead}c.target, c.name, c.token, CASE WHEN l.n IS NULL THEN {EMPTY} ELSE c.leaf END AS leaf,
                coalesce(l.n, r.n) AS ln, coalesce(l.n_max, r.n_max) AS lm, coalesce(l.sq, r.sq) AS lsq, r.k AS k
                FROM {cells_name} c LEFT JOIN {p}_leaf l ON c.target = l.target AND c.leaf = l.leaf
                LEFT JOIN (SELECT * FROM {p}_leaf WHERE len(leaf) = 0) r ON c.target = r.target""",
        ),
        (
            out,
            f"""SELECT {lead2}target, name, token, leaf, ln, lm, k,
                (o / ln + {eps}) / (1.0 + k * {eps}) AS p_obs, (lm / ln + {eps}) / (1.0 + k * {eps}) AS p_max,
                {f'(o / ln + {eps}) / (lm / ln + {eps})' if eps else 'o / lm'} AS v,
                CASE WHEN o = lm THEN 1 ELSE 0 END AS hit,
                (lsq + 2 * {eps} + k * {eps} * {eps}) / ((1.0 + k * {eps}) * (lm / ln + {eps})) AS expected
                FROM (SELECT s.*, coalesce(t.n, 0) AS o FROM {out}_s s LEFT JOIN {p}_tok t
                      ON s.target = t.target AND s.leaf = t.leaf AND s.token = t.token) q""",
        ),
    ]


def score_all(ctes, src, cols, contexts, keep="", eps=0.0, model_src=None) -> list[tuple[str, str]]:
    return [
        *ctes,
        *model("m", model_src or src, cols, contexts),
        ("cells", cells(src, cols, contexts, keep)),
        *scored("sc", "cells", "m", keep, eps),
    ]


CUST_PERM = [CUST_CTE, *permuted("cust", CUST, "region")]
LINE_PERM = [LINE_CTE, *permuted("line", LINE, "ship_half")]
CUST_BASE = [CUST_CTE, *baseline("cust", CUST, 7, "cust_base")]
CUST_PAIR = [*CUST_PERM, ("pair", union({"real": "cust", "perm": "cust_perm"}, CUST))]
LINE_PAIR = [*LINE_PERM, ("pair", union({"real": "line", "perm": "line_perm"}, LINE))]


def cols(names, prefix="") -> str:
    return ", ".join(prefix + n for n in names)


ORACLE: dict[str, str] = {}

# -- sources and sinks --
ORACLE["load_table"] = "SELECT c_custkey AS row_id, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer"
ORACLE["load_csv"] = build([CUST_CTE, MISSING_CTE], "SELECT * FROM cust_missing")
ORACLE["write_parquet"] = build([LINE_CTE], "SELECT flag, status, count(*) AS n FROM line GROUP BY flag, status")
_BY_TARGET = "SELECT name AS target, round(avg(v), 6) AS upsilon, round(avg(hit), 6) AS hit_rate FROM sc GROUP BY name"
ORACLE["model_roundtrip"] = build(score_all([CUST_CTE], "cust", CUST, CUST_CONTEXTS), _BY_TARGET)
ORACLE["from_rows"] = build([ORD_CTE], "SELECT * FROM ord_f")

# -- frame layer --
ORACLE["assert_features"] = build([CUST_CTE], "SELECT * FROM cust")
ORACLE["resolve_features"] = build([PART_CTE], "SELECT * FROM part_f")
ORACLE["project_features"] = build([LINE_CTE], "SELECT row_id, ship_half, flag, tax FROM line")
ORACLE["drop_ids"] = """
SELECT o_orderstatus, round(o_totalprice, 2) AS o_totalprice, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS o_orderdate,
       o_orderpriority FROM orders"""
ORACLE["rename_prefix"] = build(
    [PART_CTE], "SELECT row_id, " + ", ".join(f"{c} AS x{i}" for i, c in enumerate(PART)) + " FROM part_f"
)
ORACLE["round_to_int"] = """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
       CAST(CAST(round_even(l_extendedprice, 0) AS BIGINT) AS VARCHAR) AS l_extendedprice,
       CAST(CAST(round_even(l_quantity / 2, 0) AS BIGINT) AS VARCHAR) AS half_qty FROM lineitem"""
ORACLE["tokenise"] = """
SELECT p_partkey, p_name, p_brand, p_type, CAST(p_size AS VARCHAR) AS p_size,
       CAST(CAST(round(p_retailprice * 100) AS BIGINT) AS VARCHAR) AS p_retailprice FROM part"""
ORACLE["normalise_missing"] = build(
    [CUST_CTE, MISSING_CTE],
    "SELECT row_id, " + ", ".join(f"coalesce(nullif({c}, ''), '__MISSING__') AS {c}" for c in CUST) + " FROM cust_missing",
)
ORACLE["head_tail_split"] = build(
    [ORD_CTE],
    f"""SELECT CASE WHEN rn <= 5000 THEN 'train' ELSE 'test' END AS dataset, CAST(row_id AS VARCHAR) AS row_id, {cols(ORD)}
    FROM (SELECT *, row_number() OVER (ORDER BY row_id) AS rn FROM ord_f) q""",
)


def sample(src: str, n: int | str, seed) -> str:
    return f"SELECT * FROM {src} ORDER BY substr({h(seed, 'sample', 'row_id')}, 1, 13), row_id LIMIT {n}"


ORACLE["sample_n"] = build([LINE_CTE], sample("line", 1000, 123))
ORACLE["balanced_sample"] = build(
    [*CUST_PERM, ("a", sample("cust", 2000, 123)), ("b", sample("cust_perm", 2000, 123))],
    union({"real": "a", "synth": "b"}, CUST),
)
ORACLE["label_union"] = build(CUST_PAIR, "SELECT * FROM pair")
ORACLE["discretise"] = build(
    [NUM3_CTE],
    """SELECT row_id, CAST(CAST(floor(l_quantity / 10) AS BIGINT) AS VARCHAR) AS l_quantity,
       CAST(CAST(floor(l_extendedprice / 5000) AS BIGINT) AS VARCHAR) AS l_extendedprice,
       CAST(CAST(floor(l_discount / 0.0625) AS BIGINT) AS VARCHAR) AS l_discount FROM num3""",
)

# -- marginals and moments --
ORACLE["column_types"] = """
SELECT 'c_name' AS col, 'categorical' AS kind, count(DISTINCT c_name) AS levels FROM customer
UNION ALL SELECT 'c_nationkey', 'numeric', count(DISTINCT c_nationkey) FROM customer
UNION ALL SELECT 'c_acctbal', 'numeric', count(DISTINCT c_acctbal) FROM customer
UNION ALL SELECT 'c_mktsegment', 'categorical', count(DISTINCT c_mktsegment) FROM customer"""
ORACLE["marginal_numeric"] = build(
    [NUM3_CTE],
    " UNION ALL ".join(
        f"SELECT '{c}' AS col, round(avg({c}), 4) AS mean, round(stddev_pop({c}), 4) AS std FROM num3" for c in NUM3
    ),
)
_SHARE = "round(n / sum(n) OVER (PARTITION BY {k}), 9) AS p"
ORACLE["marginal_categorical"] = build(
    [LINE_CTE, ("n", counts("line", LINE))], f"SELECT col, token, n, {_SHARE.format(k='col')} FROM n"
)
ORACLE["marginal_compare"] = build(
    [*CUST_BASE, ("both_f", union({"real": "cust", "base": "cust_base"}, ["nation"], False)), ("n", counts("both_f", ["nation"], "dataset"))],
    f"SELECT dataset, col, token, n, {_SHARE.format(k='dataset')} FROM n",
)


def base_numeric(src: str, names: list[str], seed: int, out: str) -> list[tuple[str, str]]:
    picks = ", ".join(f"m_{c} + s_{c} * {z(seed, c, 'range')} AS {c}" for c in names)
    stats = ", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in names)
    return [(out, f"SELECT range AS row_id, {picks} FROM range((SELECT count(*) FROM {src})), (SELECT {stats} FROM {src}) m")]


def moments(src: str, names: list[str], out: str) -> str:
    rows = [f"SELECT 'mean' AS stat, '{c}' AS x, '{c}' AS y, avg({c}) AS {out} FROM {src}" for c in names]
    for i, a in enumerate(names):
        for b in names[i:]:
            rows.append(f"SELECT '{'var' if a == b else 'cov'}', '{a}', '{b}', covar_pop({a}, {b}) FROM {src}")
    return " UNION ALL ".join(rows)


_THOUSANDS = ("num3k", "SELECT row_id, l_quantity, l_extendedprice / 1000 AS l_extendedprice, l_discount FROM num3")
ORACLE["moment_compare"] = build(
    [
        NUM3_CTE,
        _THOUSANDS,
        *base_numeric("num3k", NUM3, 7, "syn"),
        ("a", moments("num3k", NUM3, "real_v")),
        ("b", moments("syn", NUM3, "synth_v")),
    ],
    """SELECT stat, x, y, round(real_v, 5) + 0.0 AS real, round(synth_v, 5) + 0.0 AS synth, round(real_v - synth_v, 5) + 0.0 AS diff
    FROM a JOIN b USING (stat, x, y)""",
)

# -- the conditional model --
ORACLE["fit_context"] = build(
    [LINE_CTE, *model("m", "line", LINE, LINE_CONTEXTS)],
    """SELECT t.name AS target, array_to_string(t.leaf, ',') AS context, CAST(len(t.leaf) AS INTEGER) AS context_size,
       t.token, t.n, round(t.n / l.n, 9) AS p, round(l.n_max / l.n, 9) AS p_max
    FROM m_tok t JOIN m_leaf l ON t.target = l.target AND t.leaf = l.leaf""",
)


def contingency(src: str, names: list[str], allowed: dict[str, list[str]]) -> str:
    return " UNION ALL ".join(
        f"SELECT '{t}' AS target, {names.index(p)} AS pred, '{p}' AS predictor, {p} AS x, {t} AS y, count(*) AS w "
        f"FROM {src} GROUP BY {p}, {t}"
        for t in names
        for p in allowed[t]
    )


def chi2(allowed: dict[str, list[str]], alpha: float = 0.05) -> list[tuple[str, str]]:
    from statistics import NormalDist

    crit = " ".join(
        f"WHEN '{t}' THEN {NormalDist().inv_cdf(1 - alpha / len(p))!r}" for t, p in allowed.items() if p
    )
    return [
        ("ct", contingency("cust", CUST, allowed)),
        (
            "ch",
            """SELECT target, pred, predictor, sum(w) AS n, count(DISTINCT x) AS kx, count(DISTINCT y) AS ky,
               sum(w) * (sum(CAST(w AS DOUBLE) * w / (CAST(rx AS DOUBLE) * cy)) - 1.0) AS chi2
               FROM (SELECT *, sum(w) OVER (PARTITION BY target, pred, x) AS rx,
                     sum(w) OVER (PARTITION BY target, pred, y) AS cy FROM ct) q GROUP BY target, pred, predictor""",
        ),
        (
            "cz",
            """SELECT target, pred, predictor, CAST(n AS BIGINT) AS n, chi2, (kx - 1) * (ky - 1) AS dof,
               (cbrt(greatest(chi2, 0) / ((kx - 1) * (ky - 1))) - (1.0 - 2.0 / (9.0 * (kx - 1) * (ky - 1))))
               / sqrt(2.0 / (9.0 * (kx - 1) * (ky - 1))) AS z FROM ch WHERE kx > 1 AND ky > 1""",
        ),
        ("cr", f"SELECT *, z > CASE target {crit} END AS rejected FROM cz"),
    ]


_ALL = {t: [p for p in CUST if p != t] for t in CUST}
_SCREEN = "SELECT target, predictor, n, round(chi2, 5) + 0.0 AS chi2, dof, round(z, 5) + 0.0 AS z, rejected FROM cr"
ORACLE["chi2_screen"] = build([CUST_CTE, *chi2(_ALL)], _SCREEN)
ORACLE["restrict_predictors"] = build(
    [CUST_CTE, *chi2({t: [p for p in v if p != "nation"] for t, v in _ALL.items()})], _SCREEN
)
_STUMPS = [
    *chi2(_ALL),
    ("best", "SELECT target, pred FROM cr WHERE rejected AND n >= 20 QUALIFY row_number() OVER (PARTITION BY target ORDER BY round(z, 9) DESC, pred) = 1"),
    ("nx", "SELECT c.target, c.pred, x, sum(w) AS n_x FROM ct c JOIN best b ON c.target = b.target AND c.pred = b.pred GROUP BY ALL"),
    ("lab", "SELECT *, CASE WHEN n_x >= 7 THEN pred || '=' || x ELSE pred || '*' END AS label FROM nx"),
    ("kept", "SELECT target, label FROM lab GROUP BY target, label HAVING sum(n_x) >= 7"),
    (
        "t_tok",
        """SELECT lab.target, lab.label AS path, c.y AS token, CAST(sum(c.w) AS BIGINT) AS n
           FROM lab JOIN kept ON lab.target = kept.target AND lab.label = kept.label
           JOIN ct c ON c.target = lab.target AND c.pred = lab.pred AND c.x = lab.x GROUP BY ALL
           UNION ALL SELECT col, '', token, n FROM (""" + counts("cust", CUST) + ") r",
    ),
]
ORACLE["fit_trees"] = build([CUST_CTE, *_STUMPS], "SELECT target, path, token, n FROM t_tok")


def stump_scores(src: str, keep: str) -> list[tuple[str, str]]:
    """Every coordinate of ``src`` in the leaf that its split column's token leads to."""
    split = " ".join(f"WHEN {i} THEN {c}" for i, c in enumerate(CUST))
    long = " UNION ALL ".join(
        f"SELECT {keep}, '{c}' AS target, {c} AS token, CASE (SELECT pred FROM best WHERE target = '{c}') {split} END AS x "
        f"FROM {src}"
        for c in CUST
    )
    return [
        ("t_leaf", "SELECT target, path, sum(n) AS n, max(n) AS n_max FROM t_tok GROUP BY ALL"),
        ("q_long", long),
        (
            "q_at",
            f"""SELECT {keep}, q.target, q.token, coalesce(k.label, '') AS path FROM q_long q
                LEFT JOIN lab l ON l.target = q.target AND l.x = q.x
                LEFT JOIN kept k ON k.target = l.target AND k.label = l.label""",
        ),
        (
            "q_sc",
            f"""SELECT {keep}, q.target, coalesce(o.n, 0) / f.n AS p_obs, f.n_max / f.n AS p_max,
                coalesce(o.n, 0) / f.n_max AS v, CASE WHEN o.n = f.n_max THEN 1 ELSE 0 END AS hit
                FROM q_at q JOIN t_leaf f ON f.target = q.target AND f.path = q.path
                LEFT JOIN t_tok o ON o.target = q.target AND o.path = q.path AND o.token = q.token""",
        ),
    ]


ORACLE["upsilon_matrix_trees"] = build(
    [*CUST_PERM, *_STUMPS, *stump_scores("cust_perm", "row_id")],
    "SELECT row_id, target, round(p_obs, 9) AS p_obs, round(p_max, 9) AS p_max, round(v, 9) AS v FROM q_sc",
)
ORACLE["upsilon_rows_trees"] = build(
    [*CUST_PERM, *_STUMPS, *stump_scores("cust_perm", "row_id")],
    "SELECT row_id, round(avg(v), 9) AS upsilon FROM q_sc GROUP BY row_id",
)
ORACLE["upsilon_by_target_trees"] = build(
    [*CUST_PAIR, *_STUMPS, *stump_scores("pair", "dataset")],
    """SELECT dataset, target, round(avg(v), 6) AS upsilon, round(avg(hit), 6) AS hit_rate FROM q_sc GROUP BY ALL""",
)
_FLOOR = build(
    score_all(CUST_PERM, "cust_perm", CUST, CUST_CONTEXTS, "row_id", 0.01, "cust"),
    "SELECT row_id, name AS target, round(p_obs, 9) AS p_obs, round(p_max, 9) AS p_max, round(v, 9) AS v FROM sc",
)
ORACLE["epsilon_floor"] = _FLOOR
ORACLE["predict_conditional"] = build(
    score_all([CUST_CTE], "cust", CUST, CUST_CONTEXTS, "row_id", 0.01),
    """SELECT s.row_id, s.name AS target, a.token, round((coalesce(t.n, 0) / s.ln + 0.01) / (1.0 + s.k * 0.01), 9) AS p
    FROM sc s JOIN (SELECT * FROM m_tok WHERE len(leaf) = 0) a ON s.target = a.target
    LEFT JOIN m_tok t ON s.target = t.target AND s.leaf = t.leaf AND a.token = t.token""",
)
_LINE_SCORED = score_all([LINE_CTE], "line", LINE, LINE_CONTEXTS, "row_id")
ORACLE["upsilon_matrix"] = build(
    _LINE_SCORED,
    "SELECT row_id, name AS target, round(p_obs, 9) AS p_obs, round(p_max, 9) AS p_max, round(v, 9) AS v FROM sc",
)
ORACLE["upsilon_rows"] = build(_LINE_SCORED, "SELECT row_id, round(avg(v), 9) AS upsilon FROM sc GROUP BY row_id")
_LINE_PAIR_SCORED = score_all(LINE_PAIR, "pair", LINE, LINE_CONTEXTS, "dataset, row_id", 0.0, "line")
_CUST_PAIR_SCORED = score_all(CUST_PAIR, "pair", CUST, CUST_CONTEXTS, "dataset, row_id", 0.0, "cust")
ORACLE["upsilon_mean"] = build(
    _LINE_PAIR_SCORED, "SELECT dataset, round(avg(v), 6) AS upsilon_mean FROM sc GROUP BY dataset"
)


def summary(n_feat: int, alpha: float, by: str = "") -> str:
    lead = f"{by}, " if by else ""
    group = f" GROUP BY {by}" if by else ""
    return f"""SELECT {lead}round(m, 6) AS n_rows, {float(n_feat)} AS n_features, round(u, 6) AS upsilon_mean,
        round(e, 6) AS upsilon_semibound_hoeffding, round(u - e, 6) AS upsilon_ci_lower,
        round(u + e, 6) AS upsilon_ci_upper, CAST({alpha} AS DOUBLE) AS alpha
        FROM (SELECT *, sqrt(ln(2.0 / {alpha}) / (2.0 * m * {n_feat})) AS e FROM
              (SELECT {lead}CAST(count(*) / {n_feat} AS DOUBLE) AS m, avg(v) AS u FROM sc{group}) a) b"""


ORACLE["upsilon_summary"] = build(_LINE_SCORED, summary(len(LINE), 0.05).replace("7.0 AS n_features", "CAST(7 AS DOUBLE) AS n_features"))
ORACLE["upsilon_by_target"] = build(
    _CUST_PAIR_SCORED,
    "SELECT dataset, name AS target, round(avg(v), 6) AS upsilon, round(avg(hit), 6) AS hit_rate FROM sc GROUP BY dataset, name",
)
ORACLE["upsilon_histogram"] = build(
    _CUST_PAIR_SCORED,
    """SELECT dataset, CAST(least(floor(round(u, 9) * 20), 19) AS BIGINT) AS bin, count(*) AS n
    FROM (SELECT dataset, row_id, avg(v) AS u FROM sc GROUP BY dataset, row_id) q GROUP BY ALL""",
)
ORACLE["upsilon_quantiles"] = build(
    _LINE_PAIR_SCORED,
    """SELECT dataset, round(quantile_cont(u, 0.5), 6) AS median, round(quantile_cont(u, 0.95), 6) AS p95
    FROM (SELECT dataset, row_id, avg(v) AS u FROM sc GROUP BY dataset, row_id) q GROUP BY dataset""",
)
ORACLE["map_hit_rate"] = build(_LINE_SCORED, "SELECT round(avg(hit), 6) AS hit_rate FROM sc")
ORACLE["expected_upsilon"] = build(
    _CUST_PAIR_SCORED,
    "SELECT dataset, round(avg(expected), 6) AS expected_upsilon, round(avg(v), 6) AS upsilon_mean FROM sc GROUP BY dataset",
)
ORACLE["delta_upsilon"] = build(
    _LINE_PAIR_SCORED,
    f"""SELECT round(ur, 6) AS upsilon_real, round(us, 6) AS upsilon_syn, round(ur - us, 6) AS delta, round(rad, 6) AS radius,
        round(greatest(-1, least(1, ur - us - rad)), 6) AS ci_lower, round(greatest(-1, least(1, ur - us + rad)), 6) AS ci_upper
    FROM (SELECT *, sqrt(ln(4 / 0.05) / (2.0 * mr * {len(LINE)})) + sqrt(ln(4 / 0.05) / (2.0 * ms * {len(LINE)})) AS rad FROM
      (SELECT avg(v) FILTER (dataset = 'real') AS ur, avg(v) FILTER (dataset = 'perm') AS us,
       count(*) FILTER (dataset = 'real') / {len(LINE)} AS mr, count(*) FILTER (dataset = 'perm') / {len(LINE)} AS ms FROM sc) a) b""",
)
ORACLE["map_distance"] = build(
    [
        *LINE_PERM,
        ("pair", union({"a": "line", "b": "line_perm"}, LINE)),
        *model("m", "line", LINE, LINE_CONTEXTS),
        *model("w", "line_perm", LINE, LINE_CONTEXTS),
        ("cells", cells("pair", LINE, LINE_CONTEXTS, "dataset, row_id")),
        *scored("s1", "cells", "m", "dataset, row_id"),
        *scored("s2", "cells", "w", "dataset, row_id"),
    ],
    f"""SELECT CAST(m AS BIGINT) AS m, round(d, 6) AS distance, round(rad, 6) AS radius,
        round(greatest(0, least(1, d - rad)), 6) AS ci_lower, round(greatest(0, least(1, d + rad)), 6) AS ci_upper
    FROM (SELECT *, sqrt(ln(2 / 0.05) / (2.0 * m * {len(LINE)})) + 0.02 AS rad FROM
      (SELECT count(*) // {len(LINE)} AS m, avg(abs(a.v - b.v)) AS d FROM s1 a JOIN s2 b
       ON a.dataset = b.dataset AND a.row_id = b.row_id AND a.target = b.target) q) w""",
)
ORACLE["hoeffding_radius_table"] = build(
    [ORD_CTE],
    """SELECT status, m, round(sqrt(ln(2 / 0.05) / (2.0 * m * 4)), 9) AS radius_05,
       round(sqrt(ln(2 / 0.01) / (2.0 * m * 4)), 9) AS radius_01, round(sqrt(ln(4 / 0.05) / (2.0 * m * 4)), 9) AS radius_split
    FROM (SELECT status, count(*) AS m FROM ord_f GROUP BY status) q""",
)


def brook_cells() -> str:
    parts = []
    for i, c in enumerate(CUST):
        ctx = ", ".join(f"c.{g}" if CUST.index(g) < i else f"x.{g}" for g in CUST_CONTEXTS[c])
        for sign, tok in ((1.0, f"c.{c}"), (-1.0, f"x.{c}")):
            parts.append(
                f"SELECT c.row_id, CAST({sign} AS DOUBLE) AS sign, {i} AS target, '{c}' AS name, [{ctx}] AS leaf, {tok} AS token "
                "FROM cust c, (SELECT * FROM cust ORDER BY row_id LIMIT 1) x"
            )
    return " UNION ALL ".join(parts)


ORACLE["brook_logodds"] = build(
    [CUST_CTE, *model("m", "cust", CUST, CUST_CONTEXTS), ("cells", brook_cells()), *scored("sc", "cells", "m", "row_id, sign", 0.01)],
    "SELECT row_id, round(sum(sign * ln(p_obs)), 6) + 0.0 AS log_odds FROM sc GROUP BY row_id",
)


def gaussian_given_two(src: str, y: str, a: str, b: str) -> str:
    """Alignment of ``y`` given two columns: the regression's coefficients solved by hand."""
    beta_a = f"(c_{y}_{a} * c_{b}_{b} - c_{y}_{b} * c_{a}_{b}) / (c_{a}_{a} * c_{b}_{b} - c_{a}_{b} * c_{a}_{b})"
    beta_b = f"(c_{y}_{b} * c_{a}_{a} - c_{y}_{a} * c_{a}_{b}) / (c_{a}_{a} * c_{b}_{b} - c_{a}_{b} * c_{a}_{b})"
    rest = f"({y} - m_{y}) - {beta_a} * ({a} - m_{a}) - {beta_b} * ({b} - m_{b})"
    left = f"(c_{y}_{y} - {beta_a} * c_{y}_{a} - {beta_b} * c_{y}_{b})"
    return f"SELECT '{y}' AS target, round(avg(exp(-0.5 * power({rest}, 2) / {left})), 6) AS upsilon FROM {src}, g"


ORACLE["gaussian_upsilon"] = build(
    [
        NUM3_CTE,
        (
            "g",
            "SELECT "
            + ", ".join(f"avg({c}) AS m_{c}" for c in NUM3)
            + ", "
            + ", ".join(f"covar_pop({x}, {y}) AS c_{x}_{y}" for x in NUM3 for y in NUM3)
            + " FROM num3",
        ),
    ],
    " UNION ALL ".join(
        gaussian_given_two("num3", c, *[d for d in NUM3 if d != c]) for c in NUM3
    ),
)

# -- generators --
ORACLE["gen_baseline"] = build([LINE_CTE, *baseline("line", LINE, 7, "syn")], "SELECT * FROM syn")
ORACLE["gen_baseline_numeric"] = build(
    [NUM3_CTE, *base_numeric("num3", NUM3, 7, "syn")],
    "SELECT row_id, " + ", ".join(f"round({c}, 3) + 0.0 AS {c}" for c in NUM3) + " FROM syn",
)


def sequential(src: str, names: list[str], contexts: dict, seed: int) -> list[tuple[str, str]]:
    out = [
        *model("m", src, names, contexts),
        cdf("gcdf", "m_tok", "target, leaf"),
        ("g0", f"SELECT range AS row_id FROM range((SELECT count(*) FROM {src}))"),
    ]
    for i, c in enumerate(names):
        ctx = contexts.get(c, [])
        leaf = f"[{', '.join(ctx)}]" if ctx else EMPTY
        out.append(
            (
                f"g{i + 1}",
                f"""SELECT q.* EXCLUDE (leaf, idx), t.token AS {c} FROM
                    (SELECT d.*, {leaf} AS leaf, {index(u(seed, c, 'row_id'), 's.total')} AS idx FROM g{i} d
                     JOIN (SELECT leaf AS sl, max(total) AS total FROM gcdf WHERE target = {i} GROUP BY leaf) s ON s.sl = {leaf}) q
                    JOIN gcdf t ON t.target = {i} AND t.leaf = q.leaf AND q.idx >= t.lo AND q.idx < t.hi""",
            )
        )
    return out


ORACLE["gen_sequential"] = build(
    [CUST_CTE, *sequential("cust", CUST, {c: CUST[:i] for i, c in enumerate(CUST) if i}, 123)],
    "SELECT * FROM g4",
)
# The only hole of a row is its segment, drawn given the balance of rows that have one.
ORACLE["complete_rows"] = build(
    [
        CUST_CTE,
        MISSING_CTE,
        ("seen", "SELECT bal, segment, count(*) AS n FROM cust_missing WHERE segment <> '' GROUP BY ALL"),
        (
            "upto",
            """SELECT *, sum(n) OVER (PARTITION BY bal ORDER BY segment) AS hi, sum(n) OVER (PARTITION BY bal) AS total,
               sum(n) OVER (PARTITION BY bal ORDER BY segment) - n AS lo FROM seen""",
        ),
        ("drawn", f"SELECT *, {u(5, 'fill|segment', 'row_id')} AS u FROM cust_missing"),
    ],
    """SELECT d.row_id, d.region, d.nation, CASE WHEN d.segment <> '' THEN d.segment ELSE t.segment END AS segment, d.bal
    FROM drawn d JOIN upto t ON t.bal = d.bal AND floor(d.u * t.total) >= t.lo AND floor(d.u * t.total) < t.hi""",
)
ORACLE["gen_custom"] = build(
    [CUST_CTE, *baseline("cust", CUST, 3, "syn", f"SELECT col, token, 1 AS n FROM ({counts('cust', CUST)}) q")],
    "SELECT * FROM syn",
)
ORACLE["gen_bootstrap"] = build(
    [
        ORD_CTE,
        ("rk", f"SELECT *, row_number() OVER (ORDER BY {h(9, 'bootstrap', 'row_id')}, row_id) AS rk FROM ord_f"),
        (
            "pick",
            f"SELECT range AS row_id, {index(u(9, 'pick', 'range'), '(SELECT count(*) FROM ord_f)')} + 1 AS rk "
            "FROM range((SELECT count(*) FROM ord_f))",
        ),
    ],
    f"SELECT pick.row_id, rk.row_id AS src_id, {cols(ORD)} FROM pick JOIN rk ON pick.rk = rk.rk",
)
ORACLE["gen_bootstrap_sample"] = build([LINE_CTE], sample("line", 1000, 9))
_CUBE = ", ".join(f"({u(0, 'u' + c, 'o_orderkey')} * 2.0 - 1.0) * sqrt(3.0) AS {c}" for c in ("x1", "x2", "x3"))
_BELL = ", ".join(f"{z(0, 'g' + c, 'o_orderkey')} AS {c}" for c in ("x1", "x2", "x3"))
_SHEAR = "round(x1 + 0.5 * x2, 6) + 0.0 AS x1, round(x2 + 0.5 * x3, 6) + 0.0 AS x2, round(x3, 6) + 0.0 AS x3"
ORACLE["gen_moment_pair"] = f"""
SELECT 'uniform' AS dataset, row_id, {_SHEAR} FROM (SELECT CAST(o_orderkey AS VARCHAR) AS row_id, {_CUBE} FROM orders) a
UNION ALL SELECT 'gaussian', row_id, {_SHEAR} FROM (SELECT CAST(o_orderkey AS VARCHAR) AS row_id, {_BELL} FROM orders) b"""
ORACLE["generate"] = build([ORD_CTE, *baseline("ord_f", ORD, 7, "syn")], "SELECT * FROM syn")


def normal_equations() -> str:
    """Mean alignment of three Gaussian columns by the closed-form 3x3 precision matrix."""
    s = lambda i, j: f"s{min(i, j)}{max(i, j)}"
    cof = {}
    for i in range(3):
        for j in range(3):
            a, b = [k for k in range(3) if k != i]
            c, d = [k for k in range(3) if k != j]
            sign = "" if (i + j) % 2 == 0 else "-"
            cof[i, j] = f"{sign}({s(a, c)} * {s(b, d)} - {s(a, d)} * {s(b, c)})"
    det = " + ".join(f"{s(0, j)} * ({cof[0, j]})" for j in range(3))
    vs = []
    for i in range(3):
        dot = " + ".join(f"({cof[i, j]}) / det * (x{j + 1} - m{j})" for j in range(3))
        vs.append(f"exp(-0.5 * power({dot}, 2) / (({cof[i, i]}) / det))")
    return f"SELECT avg(({' + '.join(vs)}) / 3.0) AS u FROM bell, (SELECT *, {det} AS det FROM gs) d"


_LID = LINE_ID
ORACLE["moment_pair_alignment"] = build(
    [
        (
            "cube",
            "SELECT row_id, " + ", ".join(
                f"CAST(CAST(floor((({u(0, 'ux' + str(i), 'row_id')} * 2.0 - 1.0) * sqrt(3.0) + sqrt(3.0)) / {2.0 * 3.0**0.5 / 4.0!r}) AS BIGINT) AS VARCHAR) AS x{i}"
                for i in (1, 2, 3)
            ) + f" FROM (SELECT {_LID} AS row_id FROM lineitem) q",
        ),
        ("bell", "SELECT row_id, " + ", ".join(f"{z(0, 'gx' + str(i), 'row_id')} AS x{i}" for i in (1, 2, 3)) + f" FROM (SELECT {_LID} AS row_id FROM lineitem) q"),
        (
            "gs",
            "SELECT " + ", ".join(f"avg(x{i + 1}) AS m{i}" for i in range(3)) + ", "
            + ", ".join(f"covar_pop(x{i + 1}, x{j + 1}) AS s{i}{j}" for i in range(3) for j in range(i, 3)) + " FROM bell",
        ),
        *score_all([], "cube", ["x1", "x2", "x3"], {}),
        ("ng", normal_equations()),
    ],
    "SELECT 'uniform' AS cube, round(avg(v), 6) AS upsilon FROM sc UNION ALL SELECT 'gaussian', round(u, 6) FROM ng",
)

# -- novelty --


def agree(names: list[str], a: str = "a", b: str = "b") -> str:
    return " + ".join(f"CASE WHEN {a}.{c} = {b}.{c} THEN 1 ELSE 0 END" for c in names)


ORACLE["pair_similarity"] = build(
    LINE_PERM,
    f"""SELECT a.row_id AS left_id, b.row_id AS right_id, round(({agree(LINE)}) / 7.0, 9) AS match
    FROM line a JOIN line_perm b ON a.row_id = b.row_id""",
)
ORACLE["pair_cosine"] = build(
    CUST_BASE,
    f"""SELECT a.row_id AS left_id, b.row_id AS right_id, round(({agree(CUST)}) / 4.0, 9) AS cosine
    FROM cust a JOIN cust_base b ON a.row_id = b.row_id""",
)
_BLOCKS = {"real_real": ("cust", "cust"), "real_synth": ("cust", "cust_base"), "synth_synth": ("cust_base", "cust_base")}
ORACLE["similarity_histogram"] = build(
    CUST_BASE,
    " UNION ALL ".join(
        f"SELECT '{k}' AS block, CAST({agree(CUST)} AS INTEGER) AS matches, count(*) AS pairs FROM {a} a, {b} b GROUP BY 1, 2"
        for k, (a, b) in _BLOCKS.items()
    ),
)
_BLOCKS4 = {**_BLOCKS, "synth_real": ("cust_base", "cust")}
ORACLE["block_means"] = build(
    CUST_BASE,
    " UNION ALL ".join(
        f"SELECT '{k}' AS block, round(avg(({agree(CUST)}) / 4.0), 6) AS similarity FROM {a} a, {b} b"
        for k, (a, b) in _BLOCKS4.items()
    ),
)


def linear_blocks(real: str, synth: str, names: list[str]) -> list[tuple[str, str]]:
    return [
        ("nr", counts(real, names)),
        ("ns", counts(synth, names)),
        ("pr", "SELECT col, token, n / sum(n) OVER (PARTITION BY col) AS p FROM nr"),
        ("ps", "SELECT col, token, n / sum(n) OVER (PARTITION BY col) AS p FROM ns"),
    ]


ORACLE["block_means_line"] = build(
    [*LINE_PERM, *linear_blocks("line", "line_perm", LINE)],
    " UNION ALL ".join(
        f"SELECT '{k}' AS block, round(sum(a.p * b.p) / 7.0, 6) AS similarity FROM {a} a JOIN {b} b ON a.col = b.col AND a.token = b.token"
        for k, a, b in (("real_real", "pr", "pr"), ("real_synth", "pr", "ps"), ("synth_real", "ps", "pr"), ("synth_synth", "ps", "ps"))
    ),
)
ORACLE["nearest_real"] = build(
    CUST_BASE,
    f"""SELECT b.row_id, round(max({agree(CUST)}) / 4.0, 9) AS eta
    FROM cust_base b, (SELECT DISTINCT {cols(CUST)} FROM cust) a GROUP BY b.row_id""",
)
# All pairs of distinct records, columns as integer codes to keep it affordable.
_CODES = ", ".join(f"dense_rank() OVER (ORDER BY {c}) AS k{i}" for i, c in enumerate(LINE))
_SAME = " + ".join(f"CAST(a.k{i} = b.k{i} AS UTINYINT)" for i in range(len(LINE)))
ORACLE["nearest_real_line"] = build(
    [
        LINE_CTE,
        *baseline("line", LINE, 7, "syn"),
        ("distinct_f", f"SELECT DISTINCT 0 AS side, {cols(LINE)} FROM line UNION ALL SELECT DISTINCT 1, {cols(LINE)} FROM syn"),
        ("coded", f"SELECT *, {_CODES} FROM distinct_f"),
        (
            "near",
            f"""SELECT {cols(LINE, 'b.')}, max({_SAME}) AS m FROM (SELECT * FROM coded WHERE side = 1) b,
            (SELECT * FROM coded WHERE side = 0) a GROUP BY {cols(LINE, 'b.')}""",
        ),
    ],
    f"SELECT s.row_id, round(m / 7.0, 9) AS eta FROM syn s JOIN near n ON {' AND '.join(f's.{c} = n.{c}' for c in LINE)}",
)
_BOOT = ("boot", f"SELECT * FROM cust ORDER BY substr({h(9, 'sample', 'row_id')}, 1, 13), row_id LIMIT (SELECT count(*) FROM cust)")
_THREE = [
    *CUST_PERM,
    *baseline("cust", CUST, 7, "cust_base"),
    _BOOT,
]


def eta(src: str) -> list[tuple[str, str]]:
    return [
        ("pat", f"SELECT DISTINCT {cols(CUST)} FROM {src}"),
        ("realp", f"SELECT DISTINCT {cols(CUST)} FROM cust"),
        ("near", f"SELECT {cols(CUST, 'b.')}, max({agree(CUST)}) / 4.0 AS eta FROM pat b, realp a GROUP BY {cols(CUST, 'b.')}"),
        ("etas", f"SELECT p.dataset, n.eta FROM {src} p JOIN near n ON " + " AND ".join(f"p.{c} = n.{c}" for c in CUST)),
    ]


_ETA = """round(avg(eta), 6) AS nearest_real_similarity_mean, round(quantile_cont(eta, 0.5), 6) AS nearest_real_similarity_median,
  round(quantile_cont(eta, 0.95), 6) AS nearest_real_similarity_p95,
  round(avg(CASE WHEN eta = 1 THEN 1.0 ELSE 0.0 END), 6) AS exact_reuse"""
ORACLE["novelty_summary"] = build(
    [*_THREE, ("three", union({"boot": "boot", "perm": "cust_perm", "base": "cust_base"}, CUST)), *eta("three")],
    f"SELECT dataset, count(*) AS n_synth, {_ETA} FROM etas GROUP BY dataset",
)
ORACLE["exact_reuse"] = build(
    [*LINE_PERM, ("seen", f"SELECT DISTINCT {cols(LINE)} FROM line")],
    f"""SELECT count(*) AS n_synth, count(s.flag) AS n_reused, round(count(s.flag) / count(*), 9) AS share
    FROM line_perm p LEFT JOIN seen s ON {' AND '.join(f'p.{c} = s.{c}' for c in LINE)}""",
)

# -- classifier two-sample test --
ORACLE["one_hot"] = build(
    [CUST_CTE],
    "SELECT row_id, CAST((SELECT " + " + ".join(f"count(DISTINCT {c})" for c in CUST) + f" FROM cust) + {len(CUST)} AS INTEGER) AS slots, "
    f"CAST({len(CUST)} AS DOUBLE) AS active FROM cust",
)


def labelled(a: str, b: str) -> tuple[str, str]:
    return (
        "lab",
        f"SELECT '0|' || CAST(row_id AS VARCHAR) AS key, 0 AS y FROM {a} UNION ALL SELECT '1|' || CAST(row_id AS VARCHAR), 1 FROM {b}",
    )


ORACLE["stratified_split"] = build(
    [*CUST_PERM, labelled("cust", "cust_perm")],
    f"""SELECT key, y, row_number() OVER (PARTITION BY y ORDER BY {h(123, 'split', 'key')}, key)
        <= ceil(0.25 * count(*) OVER (PARTITION BY y)) AS is_test FROM lab""",
)
ORACLE["stratified_folds"] = build(
    [*LINE_PERM, labelled("line", "line_perm")],
    f"""SELECT key, y, CAST((row_number() OVER (PARTITION BY y ORDER BY {h(123, 'fold', 'key')}, key) - 1) % 5 AS INTEGER) AS fold
    FROM lab""",
)
ORACLE["auc_rank"] = build(
    [
        LINE_CTE,
        ("sc", "SELECT ship_year, CAST(disc AS DOUBLE) / 10.0 AS s, CASE WHEN flag = 'R' THEN 1 ELSE 0 END AS y FROM line"),
        (
            "rk",
            """SELECT *, rank() OVER (PARTITION BY ship_year ORDER BY s) + (count(*) OVER (PARTITION BY ship_year, s) - 1) / 2.0 AS mid
            FROM sc""",
        ),
    ],
    """SELECT ship_year, round((sum(mid) FILTER (y = 1) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * sum(1 - y)), 9) AS auc,
       CAST(sum(y) AS BIGINT) AS n_pos, CAST(sum(1 - y) AS BIGINT) AS n_neg FROM rk GROUP BY ship_year""",
)

# -- comparison --
_DATASETS = {"real": "cust", "baseline": "cust_base", "permuted": "cust_perm", "bootstrap": "boot"}
_EVAL = [
    *_THREE,
    ("pool", union(_DATASETS, CUST)),
    *model("m", "cust", CUST, CUST_CONTEXTS),
    ("cells", cells("pool", CUST, CUST_CONTEXTS, "dataset, row_id")),
    *scored("sc", "cells", "m", "dataset, row_id"),
    ("ups", "SELECT dataset, row_id, avg(v) AS u FROM sc GROUP BY dataset, row_id"),
    ("med", "SELECT dataset, quantile_cont(u, 0.5) AS um FROM ups GROUP BY dataset"),
    *eta("pool"),
    ("nov", f"SELECT dataset, {_ETA} FROM etas GROUP BY dataset"),
    (
        "agg",
        "SELECT dataset, count(*) // 4 AS n_rows, avg(v) AS um, avg(hit) AS hr, avg(expected) AS ex FROM sc GROUP BY dataset",
    ),
]
ORACLE["evaluate_generators"] = build(
    _EVAL,
    """SELECT agg.dataset, CAST(n_rows AS BIGINT) AS n_rows, round(agg.um, 6) AS upsilon_mean, round(hr, 6) AS hit_rate,
       round(ex, 6) AS expected_upsilon, round(sqrt(ln(2 / 0.05) / (2.0 * n_rows * 4)), 6) AS radius,
       round(med.um, 6) AS upsilon_median, nov.* EXCLUDE (dataset)
    FROM agg JOIN med ON agg.dataset = med.dataset JOIN nov ON agg.dataset = nov.dataset""",
)
ORACLE["generator_map"] = build(
    _EVAL,
    """SELECT nov.dataset AS generator, nearest_real_similarity_median, round(1.0 / nearest_real_similarity_median, 6) AS inverse_median,
       round(med.um, 6) AS upsilon_median FROM nov JOIN med ON nov.dataset = med.dataset WHERE nov.dataset <> 'real'""",
)
ORACLE["generate_and_score"] = build(
    score_all(CUST_BASE, "cust_base", CUST, CUST_CONTEXTS, "row_id", 0.0, "cust"),
    "SELECT row_id, round(avg(v), 9) AS upsilon FROM sc GROUP BY row_id",
)
ORACLE["fidelity_report"] = build(
    score_all(
        [*CUST_PERM, *baseline("cust", CUST, 7, "cust_base"), ("pool", union({"real": "cust", "perm": "cust_perm", "base": "cust_base"}, CUST))],
        "pool", CUST, CUST_CONTEXTS, "dataset", 0.0, "cust",
    ),
    summary(len(CUST), 0.05, "dataset").replace("4.0 AS n_features", "CAST(4 AS DOUBLE) AS n_features"),
)
