"""SQL that fits a model step by step, to hold the fitted models against."""

from __future__ import annotations

from collections.abc import Sequence


def _solved(size: int, source: str) -> str:
    """Row(s) of ``source`` with ``h{i}_{j}`` (positive definite) and ``r{i}``, plus ``s{i}`` with H s = r, by elimination."""
    sql = f"SELECT * FROM {source}"
    for k in range(size - 1):
        cells = []
        for i in range(k + 1, size):
            cells += [f"h{i}_{j} - h{i}_{k} * h{k}_{j} / h{k}_{k} AS h{i}_{j}" for j in range(k + 1, size)]
            cells.append(f"r{i} - h{i}_{k} * r{k} / h{k}_{k} AS r{i}")
        sql = f"SELECT * REPLACE ({', '.join(cells)}) FROM ({sql})"
    for k in range(size - 1, -1, -1):
        known = "".join(f" - h{k}_{j} * s{j}" for j in range(k + 1, size))
        sql = f"SELECT *, (r{k}{known}) / h{k}_{k} AS s{k} FROM ({sql})"
    return sql


def newton(train: str, cols: Sequence[str], label: str, name: str, mask: str, steps: int = 8) -> list[str]:
    """Common table expressions of Newton steps for the logistic regression with C = 1 of a summed loss.

    ``mask`` is a one-row table of ``m{i}``, 0 for columns left out, whose weights stay 0. The last
    one, ``{name}{steps}``, has the weights ``w{i}``, the intercept being the last.
    """
    size = len(cols) + 1
    x = [f"({c} * m{i})" for i, c in enumerate(cols)] + ["1.0"]
    out = [f"{name}0 AS MATERIALIZED (SELECT " + ", ".join(f"0::DOUBLE AS w{i}" for i in range(size)) + ")"]
    margin = " + ".join(f"w{i} * {x[i]}" for i in range(size))
    sums = [f"sum((p - {label}) * {x[i]}) AS g{i}" for i in range(size)]
    sums += [f"sum(p * (1 - p) * {x[i]} * {x[j]}) AS g{i}_{j}" for i in range(size) for j in range(size)]
    for n in range(steps):
        ridge = [f"g{i}_{j}{' + 1' if i == j < size - 1 else ''} AS h{i}_{j}" for i in range(size) for j in range(size)]
        ridge += [f"g{i}{f' + w{i}' if i < size - 1 else ''} AS r{i}" for i in range(size)]
        out.append(
            f"{name}s{n} AS MATERIALIZED (SELECT {', '.join(ridge)}, {', '.join(f'w{i}' for i in range(size))} FROM "
            f"(SELECT {', '.join(sums)} FROM (SELECT *, 1 / (1 + exp(-({margin}))) AS p FROM {train}, {mask}, {name}{n})), {name}{n})"
        )
        moved = ", ".join(f"w{i} - s{i} AS w{i}" for i in range(size))
        out.append(f"{name}{n + 1} AS MATERIALIZED (SELECT {moved} FROM ({_solved(size, f'{name}s{n}')}))")
    return out


def elimination(train: str, cols: Sequence[str], label: str, steps: int = 8) -> list[str]:
    """Common table expressions of a recursive elimination; the last, ``ranks``, is (rank, feature)."""
    size, out, found = len(cols), [], []
    out.append("mask0 AS (SELECT " + ", ".join(f"1 AS m{i}" for i in range(size)) + ")")
    for n in range(size - 1):
        out += newton(train, cols, label, f"fit{n}_", f"mask{n}", steps)
        cells = " UNION ALL ".join(f"SELECT {i} AS i, w{i} * w{i} AS size FROM fit{n}_{steps}, mask{n} WHERE m{i} = 1" for i in range(size))
        out.append(f"gone{n} AS MATERIALIZED (SELECT arg_min(i, size) AS gone FROM ({cells}))")
        out.append(
            f"mask{n + 1} AS MATERIALIZED (SELECT "
            + ", ".join(f"CASE WHEN gone = {i} THEN 0 ELSE m{i} END AS m{i}" for i in range(size))
            + f" FROM mask{n}, gone{n})"
        )
        found.append(f"SELECT {size - n} AS rank, gone AS i FROM gone{n}")
    found += [f"SELECT 1, {i} FROM mask{size - 1} WHERE m{i} = 1" for i in range(size)]
    names = ", ".join(f"({i}, '{c}')" for i, c in enumerate(cols))
    out.append(f"ranks AS (SELECT CAST(rank AS INTEGER) AS rank, feature FROM ({' UNION ALL '.join(found)}) JOIN (VALUES {names}) n(i, feature) USING (i))")
    return out


def balanced(source: str, cols: Sequence[str], label: str, scaled: bool = True) -> list[str]:
    """Common table expressions of the balanced (and scaled) train part of ``source`` (user_id, label, columns, is_train)."""
    scale = [f"(CAST({c} AS DOUBLE) - avg({c}) OVER ()) / coalesce(nullif(stddev_pop({c}) OVER (), 0), 1) AS {c}" for c in cols]
    return [
        f"""numbered AS (SELECT *, row_number() OVER (PARTITION BY {label}
        ORDER BY md5(CAST(user_id AS VARCHAR)), user_id) AS rn FROM {source} WHERE is_train AND {label} IS NOT NULL)""",
        f"""train AS MATERIALIZED (SELECT user_id, {label}, {', '.join(scale if scaled else cols)} FROM numbered
        WHERE rn <= (SELECT min(n) FROM (SELECT count(*) AS n FROM numbered GROUP BY {label})))""",
    ]


def tree(rows: str, cols: Sequence[str], depth: int, part: str, valid: str, opened: str, gains: str) -> list[str]:
    """Common table expressions of a tree of ``depth`` over ``rows`` (is_train, s0, s1 and ``cols``), trying every cut.

    ``part``, ``valid`` and ``opened`` are SQL over the sums {0} and {1}; ``gains`` may use quality and whole. The
    last, ``node{depth}``, has every row with its node and the sums t0 and t1 of the node's training rows.
    """

    def over(text: str, a: str, b: str) -> str:
        return text.format(a, b)

    out = [f"node0 AS MATERIALIZED (SELECT *, 1 AS node FROM {rows})"]
    for k in range(depth):
        out.append(
            f"""cells{k} AS (SELECT node, f, v, sum(s0) AS s0, sum(s1) AS s1 FROM (
            SELECT node, s0, s1, unnest(range(0, {len(cols)})) AS f, unnest([{', '.join(cols)}]) AS v FROM node{k} WHERE is_train) GROUP BY 1, 2, 3)"""
        )
        out.append(
            f"""cuts{k} AS (SELECT *, CASE WHEN {over(valid, 'l0', 'l1')} AND {over(valid, '(t0 - l0)', '(t1 - l1)')}
            THEN {over(part, 'l0', 'l1')} + {over(part, '(t0 - l0)', '(t1 - l1)')} END AS quality, {over(part, 't0', 't1')} AS whole FROM (
            SELECT node, f, v + (lead(v) OVER w - v) / 2 AS t, sum(s0) OVER w AS l0, sum(s1) OVER w AS l1,
                sum(s0) OVER (PARTITION BY node, f) AS t0, sum(s1) OVER (PARTITION BY node, f) AS t1
            FROM cells{k} WINDOW w AS (PARTITION BY node, f ORDER BY v)) WHERE t IS NOT NULL AND {over(opened, 't0', 't1')})"""
        )
        out.append(
            f"""split{k} AS MATERIALIZED (SELECT node, f, t FROM (
            SELECT *, max(quality) OVER (PARTITION BY node) AS top FROM cuts{k} WHERE quality IS NOT NULL)
            WHERE quality >= top - 1e-10 * abs(top) AND ({gains})
            QUALIFY row_number() OVER (PARTITION BY node ORDER BY f, t) = 1)"""
        )
        side = "CASE WHEN ([" + ", ".join(cols) + "])[f + 1] < t THEN 0 ELSE 1 END"
        out.append(
            f"""node{k + 1} AS MATERIALIZED (SELECT n.* EXCLUDE (node), CASE WHEN t IS NULL THEN n.node ELSE 2 * n.node + {side} END AS node
            FROM node{k} n LEFT JOIN split{k} s ON s.node = n.node)"""
        )
    out.append(
        f"""fitted AS (SELECT n.*, t0, t1 FROM node{depth} n
        JOIN (SELECT node, sum(s0) AS t0, sum(s1) AS t1 FROM node{depth} WHERE is_train GROUP BY node) USING (node))"""
    )
    return out
