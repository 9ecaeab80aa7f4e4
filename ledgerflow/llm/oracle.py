"""DuckDB SQL for the queries of this subpackage that SQL can express."""

from __future__ import annotations

_FINE = "{v} is not null and len([x for x in {v} if x is null or isnan(x) or isinf(x)]) = 0"


def _whole(vector: str, scale: int) -> str:
    return f"[cast(floor({scale} * cast(x as double)) as bigint) for x in {vector}]"


def clustering(k: int = 8, rounds: int = 10, scale: int = 1024, dimension: int = 64, seed: int = 3) -> str:
    """Every round as two tables: the assignment, and the centroids that follow from it."""
    key = f"sha256('{seed}:' || vec_id)"
    steps = [
        f"v as materialized (select vec_id, {_whole('embedding', scale)} as c from embeddings where len(embedding) = {dimension} and {_FINE.format(v='embedding')})",
        f"c0 as materialized (select row_number() over (order by {key}) - 1 as n, c from v order by {key} limit {k})",
    ]
    for t in range(rounds + 1):
        square = "cast(list_sum([(p[1] - p[2]) * (p[1] - p[2]) for p in list_zip(v.c, m.c)]) as bigint)"
        steps.append(f"a{t} as materialized (select vec_id, any_value(c) as c, min((d, n)) as best from (select v.vec_id, v.c, {square} as d, m.n from v, c{t} m) group by vec_id)")
        if t < rounds:
            mean = "list((s - ((s % size) + size) % size) // size order by pos)"
            sums = f"select n, pos, sum(x) as s, count(*) as size from (select best[2] as n, unnest(c) as x, generate_subscripts(c, 1) as pos from a{t}) group by n, pos"
            steps.append(f"c{t + 1} as materialized (select n, coalesce(m.c, old.c) as c from c{t} old left join (select n, {mean} as c from ({sums}) group by n) m using (n))")
    last = f"a{rounds}"
    return (
        f"with {', '.join(steps)} select vec_id, cast(best[2] as integer) as cluster, best[1] as distance, cast(sum(best[1]) over (partition by best[2]) as bigint) as cluster_inertia,"
        f" cast(sum(best[1]) over () as bigint) as inertia, sha256(array_to_string([cast(x as bigint) for x in m.c], ',')) as centroid_sha256 from {last} join c{rounds} m on m.n = best[2]"
    )


def hard_negatives(positives: int = 5, negatives: int = 10, scale: int = 256) -> str:
    score = "cast(list_sum([p[1] * p[2] for p in list_zip(a.c, b.c)]) as bigint)"
    return f"""
    with v as materialized (
      select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, {_whole('embedding', scale)} as c
      from embeddings where label is not null and vec_id is not null and {_FINE.format(v='embedding')}),
    s as materialized (select a.vec_id as anchor, b.vec_id as other, a.label = b.label as same, {score} as score
      from v a join v b on a.vec_id % 100 = 0 and a.vec_id <> b.vec_id and len(a.c) = len(b.c)),
    p as (select anchor, other, score from s where same qualify row_number() over (partition by anchor order by score desc, other) <= {positives})
    select p.anchor as anchor_id, p.other as positive_id, cast(row_number() over (partition by p.anchor, p.other order by s.score desc, s.other) as integer) as rank,
      s.other as negative_id, p.score as positive_score, s.score as negative_score
    from p join s on p.anchor = s.anchor and not s.same and 30 * p.score <= 100 * s.score and 100 * s.score <= 90 * p.score
    qualify rank <= {negatives}"""
