"""Fits in SQL, for the oracles: ridge by Gauss-Jordan elimination and Platt scaling by Newton steps, both as recursive queries."""

from __future__ import annotations


def ridge(p: str, rows: str, alphas: list[float]) -> str:
    """Common table expressions of ridge fits of ``rows`` (id unique, x a list, y): {p}_model (alpha, w, b) and {p}_best, that of the least leave-one-out error.

    A step of {p}_steps clears one column of (Z'Z + alpha | 1) for every alpha, so the right half ends as the inverse.
    """
    return f"""
{p}_long AS (SELECT id, y, unnest(x) AS x, generate_subscripts(x, 1) AS j FROM {rows}),
{p}_mean AS (SELECT j, avg(x) AS m FROM {p}_long GROUP BY j),
{p}_goal AS (SELECT avg(y) AS my, count(*) AS n FROM {rows}),
{p}_centred AS (SELECT id, j, x - m AS x, y - my AS y FROM {p}_long JOIN {p}_mean USING (j), {p}_goal),
{p}_gram AS (SELECT a.j AS i, b.j, sum(a.x * b.x) AS g FROM {p}_centred a JOIN {p}_centred b USING (id) GROUP BY ALL),
{p}_xy AS (SELECT list(s ORDER BY j) AS xy FROM (SELECT j, sum(x * y) AS s FROM {p}_centred GROUP BY j)),
{p}_rows AS (SELECT alpha, i, list(CASE WHEN i = j THEN g + alpha ELSE g END ORDER BY j) || list(CASE WHEN i = j THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END ORDER BY j) AS r
  FROM {p}_gram, (SELECT unnest([{", ".join(f"{a!r}::DOUBLE" for a in alphas)}]) AS alpha) GROUP BY alpha, i),
{p}_steps(alpha, k, m) AS (SELECT alpha, 0, list(r ORDER BY i) FROM {p}_rows GROUP BY alpha UNION ALL
  SELECT alpha, k + 1, list_transform(m, lambda r, i: CASE WHEN i = k + 1 THEN lead_row ELSE list_transform(r, lambda z, j: z - r[k + 1] * lead_row[j]) END)
  FROM (SELECT *, list_transform(m[k + 1], lambda z: z / m[k + 1][k + 1]) AS lead_row FROM {p}_steps WHERE k < len(m))),
{p}_inverse AS (SELECT alpha, list_transform(m, lambda r: r[len(m) + 1 :]) AS inverse FROM {p}_steps WHERE k = len(m)),
{p}_weights AS (SELECT alpha, inverse, list_transform(inverse, lambda r: list_dot_product(r, xy)) AS w FROM {p}_inverse, {p}_xy),
{p}_model AS (SELECT alpha, inverse, w, my - list_dot_product(w, mx) AS b FROM {p}_weights, {p}_goal, (SELECT list(m ORDER BY j) AS mx FROM {p}_mean)),
{p}_z AS (SELECT id, list(x ORDER BY j) AS z, any_value(y) AS y FROM {p}_centred GROUP BY id),
{p}_errors AS (SELECT alpha, sum(((y - list_dot_product(w, z)) / (1 - 1.0::DOUBLE / n - list_dot_product(z, list_transform(inverse, lambda r: list_dot_product(r, z))))) ** 2) AS error
  FROM {p}_z, {p}_model, {p}_goal GROUP BY alpha),
{p}_best AS (SELECT alpha, w, b FROM {p}_model JOIN {p}_errors USING (alpha) ORDER BY error, alpha LIMIT 1)"""


def platt(p: str, rows: str, steps: int = 40) -> str:
    """{p}_model (a, b) of the logistic fit of ``rows`` (s, t 0 or 1): total loss and half of a squared."""
    return f"""
{p}_newton(k, a, b) AS (SELECT 0, 0.0::DOUBLE, 0.0::DOUBLE UNION ALL
  SELECT k + 1, a - (hbb * ga - hab * gb) / (haa * hbb - hab * hab), b - (haa * gb - hab * ga) / (haa * hbb - hab * hab)
  FROM (SELECT k, a, b, sum((q - t) * s) + a AS ga, sum(q - t) AS gb, sum(q * (1 - q) * s * s) + 1 AS haa, sum(q * (1 - q) * s) AS hab, sum(q * (1 - q)) AS hbb
        FROM (SELECT *, 1 / (1 + exp(-(a * s + b))) AS q FROM {p}_newton, {rows} WHERE k < {steps}) GROUP BY k, a, b)),
{p}_model AS (SELECT a, b FROM {p}_newton WHERE k = {steps})"""
