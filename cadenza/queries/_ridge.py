"""Ridge fits in SQL, for comparison with the operators: weights, medians, Gram matrix, and coordinate descent as a recursion."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

COLUMNS = ("f1", "f2", "f3", "f4", "f5")


def fits_sql(train: str, masks: Mapping[str, Sequence[int]], alpha: float = 10.0, weighted: bool = True, sweeps: int = 150, columns: Sequence[str] = COLUMNS) -> str:
    """Common table expressions that end in fit(s, model, beta, mean, sd, md, ybar): a ridge for each training set s and each mask of the design's columns.

    ``train``: a query of s, label (the target), source_group, group_id and the columns. The design has the imputed values, then the
    indicators of missing ones; coordinates with a mask of 0 stay 0.
    """
    n, p = len(columns), 2 * len(columns)
    each = lambda f, k=p: "[" + ", ".join(f(i) for i in range(1, k + 1)) + "]"
    z = lambda i: f"((x[{i}] - mean[{i}]) / sd[{i}])"
    weight = "t.n / (t.l * a.ns * b.ng * c.nr)::double" if weighted else "1.0::double"
    return f"""tr0 as ({train}), tw as (select tr0.*, {weight} as wt from tr0 join (select s, count(*) n, count(distinct label) l from tr0 group by 1) t using (s) join (select s, label, count(distinct source_group) ns from tr0 group by 1, 2) a using (s, label)
    join (select s, label, source_group, count(distinct group_id) ng from tr0 group by 1, 2, 3) b using (s, label, source_group) join (select s, label, source_group, group_id, count(*) nr from tr0 group by 1, 2, 3, 4) c using (s, label, source_group, group_id)),
  med as (select s, {each(lambda i: f"coalesce(median({columns[i - 1]}), 0)::double", n)} as md from tw group by 1),
  xs as (select s, wt, label::double as y, list_concat({each(lambda i: f"coalesce({columns[i - 1]}, md[{i}])::double", n)}, {each(lambda i: f"({columns[i - 1]} is null)::int::double", n)}) as x from tw join med using (s)),
  st as (select s, sum(wt) as m, sum(wt * y) / sum(wt) as ybar, {each(lambda i: f"sum(wt * x[{i}]) / sum(wt)")} as mean from xs group by 1),
  vs as (select s, any_value(m) as m, any_value(ybar) as ybar, any_value(mean) as mean, {each(lambda i: f"sqrt(sum(wt * (x[{i}] - mean[{i}]) * (x[{i}] - mean[{i}])) / any_value(m))")} as sd0 from xs join st using (s) group by 1),
  sc as (select s, m, ybar, mean, list_transform(sd0, lambda v: case when v < 1e-8 then 1.0::double else v end) as sd from vs),
  gm as (select s, {each(lambda i: each(lambda j: f"sum(wt * {z(i)} * {z(j)})"))} as g, {each(lambda i: f"sum(wt * {z(i)} * (y - ybar))")} as b from xs join sc using (s) group by 1),
  ms as (select unnest([{', '.join(repr(k) for k in masks)}]) as model, unnest([{', '.join(str(list(v)) for v in masks.values())}]) as mask),
  rec(s, model, step, beta) as (select s, model, 0, {each(lambda i: '0.0::double')} from gm, ms
    union all select r.s, r.model, r.step + 1, list_transform(range({p}), lambda j: case when j = r.step % {p} and ms.mask[j + 1] = 1 then (gm.b[j + 1] - (list_dot_product(gm.g[j + 1], r.beta) - gm.g[j + 1][j + 1] * r.beta[j + 1])) / (gm.g[j + 1][j + 1] + {alpha}) else r.beta[j + 1] end)
    from rec r join gm on gm.s = r.s join ms on ms.model = r.model where r.step < {p * sweeps}),
  fit as (select r.s, r.model, r.beta, sc.mean, sc.sd, med.md, sc.ybar from rec r join sc on sc.s = r.s join med on med.s = r.s where r.step = {p * sweeps})"""


def score_sql(row: str = "c", columns: Sequence[str] = COLUMNS) -> str:
    """The raw score of a row by the model of a joined ``fit``."""
    n = len(columns)
    x = [f"coalesce({row}.{c}, md[{i + 1}])" for i, c in enumerate(columns)] + [f"({row}.{c} is null)::int" for c in columns]
    return "(ybar + " + " + ".join(f"({v} - mean[{i + 1}]) / sd[{i + 1}] * beta[{i + 1}]" for i, v in enumerate(x)) + ")"


def mask_of(own: Sequence[str], mode: str = "values_plus_missing", columns: Sequence[str] = COLUMNS) -> list[int]:
    v = [int(c in own) for c in columns]
    return [*(v if mode != "missingness_only" else [0] * len(v)), *(v if mode != "median_only" else [0] * len(v))]
