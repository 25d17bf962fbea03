"""Registration of queries, and test views that both engines can evaluate."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

TABLES = ("lineitem", "orders", "part", "events", "embeddings", "supplier", "customer", "nation", "region")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(name: str, sql: str | None = None, views: str = "") -> Callable[[Query], Query]:
    """Registers a query and, if given, its SQL twin; ``views`` names the test views that
    the twin reads."""

    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ctes = ", ".join(f"{v} as ({VIEWS[v]})" for v in views.split())
            recursive = "with recursive "
            if ctes and sql.startswith(recursive):
                ORACLES[name] = f"{recursive}{ctes}, {sql.removeprefix(recursive)}"
            else:
                # a twin that starts with a comma goes on with common tables of its own
                ORACLES[name] = f"with {ctes}{'' if sql.startswith(',') else ' '}{sql}" if ctes else sql
        return f

    return add


#: Test views as SQL that Spark and other engines read alike.
VIEWS = {
    "planted_q": """
        select frame_id, pk, ok, ln, h0, k0, l0, ct, st,
               h0/cast(79 as double)*ct - k0/cast(79 as double)*st + e*amp as qx,
               h0/cast(79 as double)*st + k0/cast(79 as double)*ct - e*amp as qy,
               l0/cast(38 as double) + e*amp as qz
        from (select *, (1-t*t)/(1+t*t) as ct, 2*t/(1+t*t) as st,
                     case when (pk+ok) % 3 = 0 then cast('0.006' as double) when (pk+ok) % 10 < frame_id % 11 then cast('0.02' as double) else cast('0.0008' as double) end as amp
              from (select l_suppkey as frame_id, l_partkey as pk, l_orderkey as ok, l_linenumber as ln,
                           cast((l_suppkey % 17) as double)/10 as t,
                           cast(l_partkey % 13 as int)-6 as h0, cast(l_orderkey % 11 as int)-5 as k0,
                           cast((l_partkey+l_orderkey) % 9 as int)-4 as l0,
                           (cast((l_partkey*7919 + l_orderkey*104729) % 1000 as double)-500)/500 as e
                    from lineitem) b) r""",
    "run_peaks": """
        select run_id, ev, kind, pk, ok, ln,
               case when kind = 'blank' then cast(0 as double) when kind = 'junk' then cast('0.08' as double)*u else x end as qx,
               case when kind = 'blank' then cast(0 as double) when kind = 'junk' then cast('0.08' as double)*v when kind = 'double' and (pk+ln) % 2 = 1 then cast('0.8' as double)*y - cast('0.6' as double)*z else y end as qy,
               case when kind = 'blank' then cast(0 as double) when kind = 'junk' then cast('0.08' as double)*w when kind = 'double' and (pk+ln) % 2 = 1 then cast('0.6' as double)*y + cast('0.8' as double)*z else z end as qz
        from (select *, h0/a*ct - k0/b*st + cast('0.0003' as double)*u as x, h0/a*st + k0/b*ct + cast('0.0003' as double)*v as y, l0/c + cast('0.0003' as double)*w as z
              from (select *, (1-t*t)/(1+t*t) as ct, 2*t/(1+t*t) as st,
                           cast(case kind when 'B' then 62 when 'C' then 55 else 79 end as double) as a,
                           cast(case kind when 'B' then 71 when 'C' then 92 else 79 end as double) as b,
                           cast(case kind when 'B' then 45 when 'C' then 64 else 38 end as double) as c
                    from (select *, case when ev < 4 then 'B' when ev % 9 = 4 then 'blank' when ev % 9 = 7 then 'junk' when ev % 9 = 2 then 'double' when ev % 9 = 0 then 'B'
                                         when ev % 9 = 6 and ev > 9 and ev < 30 then 'C' else 'A' end as kind
                          from (select cast(floor(l_suppkey/5) as bigint) as run_id, cast((l_suppkey % 5)*7 + l_orderkey % 7 as bigint) as ev, l_partkey as pk, l_orderkey as ok, l_linenumber as ln,
                                       cast((l_suppkey*3 + l_orderkey % 7) % 17 as double)/10 as t, cast(l_partkey % 13 as int)-6 as h0, cast(l_orderkey % 11 as int)-5 as k0, cast((l_partkey+l_orderkey) % 9 as int)-4 as l0,
                                       (cast((l_partkey*7919 + l_orderkey*104729) % 1009 as double)-504)/504 as u, (cast((l_partkey*6007 + l_orderkey*15485 + l_linenumber*31) % 997 as double)-498)/498 as v,
                                       (cast((l_partkey*3571 + l_orderkey*27644 + l_linenumber*77) % 1013 as double)-506)/506 as w
                                from lineitem) r) k) g) p""",
    "measurements": """
        select l_suppkey as frame, cast(l_partkey % 13 as int)-6 as h, cast(l_orderkey % 11 as int)-5 as k, cast(l_linenumber as int)-4 as l,
               l_extendedprice - 200000*l_discount as i, 100*l_quantity + 1 as sigma
        from lineitem""",
    "points": """
        select l_orderkey as ok, l_linenumber as ln, l_partkey as pk, l_suppkey as frame,
               (l_extendedprice*cast('7.3' as double)) % 1100 as fs,
               (l_extendedprice*cast('3.1' as double) + l_quantity*cast('11.7' as double)) % 1100 as ss
        from lineitem""",
    "panels": """
        select cast(0 as int) as ord, cast(0 as double) as min_fs, cast(511 as double) as max_fs, cast(0 as double) as min_ss, cast(511 as double) as max_ss, cast('-512.5' as double) as corner_x, cast('-512.5' as double) as corner_y
        union all select 1, 512, 1023, 0, 511, cast('0.5' as double), cast('-512.5' as double)
        union all select 2, 0, 1023, 512, 1023, cast('-512.5' as double), cast('3.5' as double)
        union all select 3, 500, 520, 500, 520, cast('-10.5' as double), cast('-10.5' as double)""",
    "detectors": """
        select cast(floor(p_partkey/16) as bigint) as det, cast(p_partkey % 16 as int) as ord,
               cast((p_partkey*37) % 96 as double) as min_fs, cast((p_partkey*37) % 96 + p_size % 24 as double) as max_fs,
               cast((p_partkey*53) % 80 as double) as min_ss, cast((p_partkey*53) % 80 + p_size % 17 as double) as max_ss,
               cast(p_size as double)/4 - 60 as corner_x, cast(p_partkey % 100 as double)/8 - 30 as corner_y,
               cast(p_size % 9 - 4 as double)/8 as fsx, cast(p_partkey % 5 - 2 as double)/4 as fsy, p_size as size
        from part""",
    "metrics": """
        select p_partkey as hyp_id, p_size % 5 as kind, cast(30 + p_partkey % 40 as double) as a,
               cast(30 + p_partkey % 40 + case when p_size % 5 in (1, 2, 3) then 0 else 13 end as double) as b,
               cast(30 + p_partkey % 40 + case when p_size % 5 = 2 then 0 else 29 end as double) as c,
               cast(case when p_size % 5 = 4 then 100 else 90 end as double) as be, cast(case when p_size % 5 = 3 then 120 else 90 end as double) as ga
        from part""",
    "frame_stream": """
        select event_id as ev, user_id as run_id, event_type as outcome,
               cast(floor(value) as bigint) as n_peaks, case when floor(value) >= 6 then 1 else 0 end as hit
        from events""",
    "cells": """
        select p_partkey % 120 as frame_id, p_partkey as hyp_id, cast(30 + (p_partkey % 4)*12 as double) as a,
               cast(45 + (p_partkey % 3)*18 as double) as b, 70 + cast(p_size as double)/10 as c
        from part""",
    "peaks_q": """
        select vec_id as frame_id, label as species, j as peak_id, cast(embedding[3*j+1] as double) as qx,
               cast(embedding[3*j+2] as double) as qy, cast(embedding[3*j+3] as double) as qz
        from embeddings, unnest(range(0, 21)) as t(j)""",
    "frame_images": """
        select frame, ss, fs, cast(10 + ((7*ss + 13*fs + 5*frame) % 5)
               + case when ss % 16 = 8 + frame % 3 and fs % 16 = 7 + frame % 2 then 150 + (frame*7 + ss) % 90
                      when ss % 16 = 8 + frame % 3 and fs % 16 = 8 + frame % 2 then 70 + (frame*7 + ss) % 30 else 0 end as double) as adu
        from (select s_suppkey as frame, cast(i // 64 as int) as ss, cast(i % 64 as int) as fs from supplier, range(0, 4096) as r(i)) g""",
    "predictions": """
        select s_suppkey as frame, cast(a as int) as h, cast(b as int) as k, 0 as l, cast(8 + s_suppkey % 3 + 16*a as int) as css, cast(7 + s_suppkey % 2 + 16*b as int) as cfs
        from supplier, (select x.i as a, y.j as b from range(0, 5) as x(i), range(0, 5) as y(j)) t""",
    "lattice_images": """
        select frame, ss, fs, h, k, cast(10 + ((7*ss + 13*fs + 5*frame) % 5) + case when h*h+k*k > 0 and h*h+k*k <= 24 and fs = px and ss = py then 150 + (37*h*h + 11*k*k + frame) % 200 else 0 end as double) as adu
        from (select *, cast(floor(64.5 + 900*(h*ct - k*st)/79) as int) as px, cast(floor(64.5 + 900*(h*st + k*ct)/79) as int) as py
              from (select *, cast(round(79*(ct*(fs-64) + st*(ss-64))/cast(900 as double), 0) as int) as h, cast(round(79*(ct*(ss-64) - st*(fs-64))/cast(900 as double), 0) as int) as k
                    from (select frame, cast(i // 128 as int) as ss, cast(i % 128 as int) as fs, (1-t*t)/(1+t*t) as ct, 2*t/(1+t*t) as st
                          from (select s_suppkey as frame, cast(s_suppkey % 17 as double)/10 as t, i from supplier, range(0, 16384) as r(i)) f) g) a) b""",
    "image": """
        select ss, fs, cast(10 + ((7*ss + 13*fs) % 5) + case when ss % 16 = 8 and fs % 16 = 8 then 200 when ss % 16 = 8 and fs % 16 = 9 then 90 else 0 end as double) as adu
        from (select cast(i // 64 as int) as ss, cast(i % 64 as int) as fs from range(0, 4096) as r(i)) g""",
}
#: Spark's spelling where the two differ.
SPARK_VIEWS = VIEWS | {
    # a frame's peaks go to one partition before the last expressions, which are not copied into each other then
    "run_peaks": VIEWS["run_peaks"].replace("from (select *, case when ev < 4", "from (select /*+ REPARTITION(run_id, ev) */ *, case when ev < 4", 1),
    "peaks_q": """
        select vec_id as frame_id, label as species, j as peak_id, cast(element_at(embedding, 3*j+1) as double) as qx,
               cast(element_at(embedding, 3*j+2) as double) as qy, cast(element_at(embedding, 3*j+3) as double) as qz
        from embeddings lateral view explode(sequence(0, 20)) t as j""",
    "frame_images": VIEWS["frame_images"].replace("i // 64", "floor(i / 64)").replace("range(0, 4096) as r(i)", "(select id as i from range(0, 4096)) r"),
    "lattice_images": VIEWS["lattice_images"].replace("i // 128", "floor(i / 128)").replace("range(0, 16384) as r(i)", "(select id as i from range(0, 16384)) r"),
    "predictions": VIEWS["predictions"].replace("range(0, 5) as x(i), range(0, 5) as y(j)", "(select id as i from range(0, 5)) x, (select id as j from range(0, 5)) y"),
    "image": VIEWS["image"].replace("i // 64", "floor(i / 64)").replace("range(0, 4096) as r(i)", "(select id as i from range(0, 4096))"),
}


def view(spark: SparkSession, sf_dir: str, name: str, hint: str = "", **tables: DataFrame) -> DataFrame:
    """A test view as a DataFrame over the tables in ``sf_dir``, or those given instead; ``hint`` goes to
    its innermost select."""
    text = SPARK_VIEWS[name]
    if hint:
        before, after = text.rsplit("select s_suppkey", 1)
        text = f"{before}select /*+ {hint} */ s_suppkey{after}"
    used = [t for t in TABLES if f"from {t}" in text]
    for t in used:
        text = text.replace(f"from {t}", f"from {{{t}}}")
    return spark.sql(text, **{t: tables[t] if t in tables else table(spark, sf_dir, t) for t in used})
