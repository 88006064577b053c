"""Pieces of SQL that several queries' counterparts share."""

from __future__ import annotations

from vectrail.sources.embeddings import IMAGES_SQL as IMAGES


def zipped(a: str, b: str, op: str) -> str:
    """Sum over places of a op b."""
    return f"list_sum(list_transform(range(1, len({a}) + 1), lambda i: {a}[i] {op} {b}[i]))"


def _each(expression: str, a: str, b: str) -> str:
    return f"list_sum(list_transform(range(1, len({a}) + 1), lambda i: {expression.format(a=f'{a}[i]', b=f'{b}[i]')}))"


def distances(a: str, b: str) -> dict[str, str]:
    size = lambda v: f"sqrt(list_sum(list_transform({v}, lambda x: x * x)))"
    return {
        "euclidean": f"sqrt({_each('({a} - {b}) * ({a} - {b})', a, b)})",
        "manhattan": _each("abs({a} - {b})", a, b),
        "minkowski3": f"pow({_each('pow(abs({a} - {b}), 3)', a, b)}, 1.0 / 3)",
        "cosine": f"{zipped(a, b, '*')} / ({size(a)} * {size(b)})",
    }


DISTANCES = distances("features", "query")


def knn_edges(measure: str, k: int, source: str = "images") -> str:
    """CTEs d and edges(src, dst, distance, rank) over all pairs."""
    d = distances("a.features", "b.features")[measure]
    down = "DESC" if measure == "cosine" else ""
    return f"""d AS (SELECT a.image_id AS src, b.image_id AS dst, {d} AS distance FROM {source} a, {source} b),
edges AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY src ORDER BY distance {down}, dst) AS INTEGER) AS rank FROM d) WHERE rank <= {k})"""


def pagerank(k: int, jump: str, name: str = "pr", iterations: int = 60, beta: float = 0.85) -> str:
    """Recursive CTE name(step, node, p) from edges and a CTE jump(node, mass)."""
    return f"""{name} AS (
  SELECT 0 AS step, node, 1.0::DOUBLE / (SELECT count(*) FROM {jump}) AS p FROM {jump}
  UNION ALL
  SELECT any_value(s.step) + 1, j.node, {beta} * coalesce(sum(s.p / {k}) FILTER (WHERE e.dst IS NOT NULL), 0) + {1 - beta:.2f} * any_value(j.mass)
  FROM {jump} j CROSS JOIN {name} s LEFT JOIN edges e ON e.src = s.node AND e.dst = j.node
  WHERE s.step < {iterations} GROUP BY j.node)"""


def latent_axes(rows: str, k: int, name: str = "ax", centred: bool = False, squarings: int = 20) -> str:
    """Common table expressions: {name}_x (image_id, i, x: cells, centred or not) and {name} (component, i, w, strength) with the
    first k axes of rows. Each axis is the limit of a matrix that is squared again and again; its largest weight is above
    zero, as a row of that limit is taken where its diagonal is greatest. The axis is then taken out of the matrix."""
    cells = f"SELECT image_id, i, features[i] AS x FROM {rows}, (SELECT unnest(range(1, len(features) + 1)) AS i FROM (SELECT features FROM {rows} LIMIT 1))"
    if centred:
        cells = f"SELECT image_id, i, x - avg(x) OVER (PARTITION BY i) AS x FROM ({cells})"
    out = [f"{name}_x AS MATERIALIZED ({cells})", f"{name}_g0 AS MATERIALIZED (SELECT a.i AS i, b.i AS j, sum(a.x * b.x) AS v FROM {name}_x a JOIN {name}_x b ON a.image_id = b.image_id GROUP BY 1, 2)"]
    for c in range(k):
        last = f"{name}_g{c}"
        for s in range(squarings):
            new = f"{name}_p{c}_{s}"
            out.append(f"{new} AS MATERIALIZED (SELECT i, j, v / (sum(CASE WHEN i = j THEN v END) OVER ()) AS v FROM (SELECT a.i AS i, b.j AS j, sum(a.v * b.v) AS v FROM {last} a JOIN {last} b ON a.j = b.i GROUP BY 1, 2))")
            last = new
        out.append(f"{name}_d{c} AS (SELECT i AS d, v AS most FROM {last} WHERE i = j ORDER BY v DESC LIMIT 1)")
        out.append(f"{name}_w{c} AS MATERIALIZED (SELECT i, v / sqrt(most) AS w FROM {last}, {name}_d{c} WHERE j = d)")
        out.append(f"{name}_l{c} AS MATERIALIZED (SELECT sum(a.w * v * b.w) / (SELECT sum(w * w) FROM {name}_w{c}) AS l FROM {name}_g{c} g JOIN {name}_w{c} a ON a.i = g.i JOIN {name}_w{c} b ON b.i = g.j)")
        out.append(f"{name}_g{c + 1} AS MATERIALIZED (SELECT g.i AS i, g.j AS j, v - l * a.w * b.w AS v FROM {name}_g{c} g JOIN {name}_w{c} a ON a.i = g.i JOIN {name}_w{c} b ON b.i = g.j, {name}_l{c})")
    out.append(f"{name} AS MATERIALIZED (" + " UNION ALL ".join(f"SELECT CAST({c} AS INTEGER) AS component, i, w, sqrt(l) AS strength FROM {name}_w{c}, {name}_l{c}" for c in range(k)) + ")")
    return ", ".join(out)


def latent_scores(cells: str, axes: str = "ax") -> str:
    """image_id, component, weight, strength of cells (image_id, i, x)."""
    return f"SELECT image_id, component, sum(x * w) AS weight, any_value(strength) AS strength FROM {cells} JOIN {axes} USING (i) GROUP BY 1, 2"
