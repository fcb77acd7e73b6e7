"""Relational queries whose SQL runs unchanged in Spark and in the oracle's engine, or differs in dialect alone.

Each entry: name -> (Spark SQL, oracle SQL or None where the text is the same).
Sums of money go through decimals, so that no order of adding changes a digit.
"""

from __future__ import annotations

MONEY = "cast(sum(cast({} as decimal(18,2))) as double)"
REVENUE = "cast(sum(cast(l_extendedprice as decimal(12,2)) * (1 - cast(l_discount as decimal(4,2)))) as double)"

QUERIES: dict[str, tuple[str, str | None]] = {
    # Scan, outer join, grouping
    "b01_label_summary": (
        """select d.source, d.lang, count(*) as n, count(l.doc_id) as labelled, cast(coalesce(sum(l.quality), 0) as bigint) as good
           from {documents} d left join {labels} l on d.doc_id = l.doc_id group by d.source, d.lang""",
        None,
    ),
    # Projection, filter, case, null-safe equality
    "b05_project_filter_case": (
        """select o_orderkey, case when o_totalprice >= 200000 then 'high' when o_totalprice >= 50000 then 'middle' else 'low' end as band,
                  nullif(o_orderstatus, 'O') is not distinct from nullif(o_orderstatus, 'F') as neither
           from {orders} where o_orderstatus in ('O', 'F') and o_orderpriority like '1%' and o_totalprice between 1000 and 1000000""",
        None,
    ),
    "b06_pivot": (
        """select * from (select user_id, event_type from {events}) pivot (count(*) for event_type in ('click' as clicks, 'purchase' as purchases, 'view' as views))""",
        """select user_id, count(*) filter (where event_type = 'click') as clicks, count(*) filter (where event_type = 'purchase') as purchases,
                  count(*) filter (where event_type = 'view') as views from events group by user_id""",
    ),
    "b06_unpivot": (
        "select doc_id, kind, mark from {labels} unpivot (mark for kind in (quality, toxic))",
        "select doc_id, 'quality' as kind, quality as mark from labels union all select doc_id, 'toxic', toxic from labels",
    ),
    "b07_explode_lines": (
        """select doc_id, cast(pos as bigint) as line_no, line from {documents} lateral view posexplode(split(text, '\\n')) t as pos, line where line <> ''""",
        """select doc_id, cast(line_no as bigint) as line_no, line from (
             select doc_id, unnest(string_split(text, chr(10))) as line, unnest(range(len(string_split(text, chr(10))))) as line_no from documents) where line <> ''""",
    ),
    # Joins
    "b08_inner_join": ("select c_name, o_orderkey, o_totalprice from {customer} join {orders} on c_custkey = o_custkey where c_mktsegment = 'BUILDING'", None),
    "b08_left_join": ("select c_custkey, count(o_orderkey) as n_orders from {customer} left join {orders} on c_custkey = o_custkey and o_orderstatus = 'F' group by c_custkey", None),
    "b08_right_join": ("select c.c_custkey, o.o_orderkey from (select * from {customer} where c_acctbal > 0) c right join {orders} o on c.c_custkey = o.o_custkey", None),
    "b08_full_join": (
        """select a.s_suppkey as left_key, b.s_suppkey as right_key from (select * from {supplier} where s_acctbal > 0) a
           full join (select * from {supplier} where s_nationkey < 12) b on a.s_suppkey = b.s_suppkey""",
        None,
    ),
    "b09_semi_join": ("select c_custkey, c_name from {customer} left semi join {orders} on c_custkey = o_custkey and o_totalprice > 100000", "select c_custkey, c_name from customer where exists (select 1 from orders where c_custkey = o_custkey and o_totalprice > 100000)"),
    "b09_anti_join": ("select c_custkey, c_name from {customer} left anti join {orders} on c_custkey = o_custkey and o_orderstatus = 'F'", "select c_custkey, c_name from customer where not exists (select 1 from orders where c_custkey = o_custkey and o_orderstatus = 'F')"),
    "b09_not_in": ("select p_partkey from {part} where p_partkey not in (select l_partkey from {lineitem} where l_quantity > 40)", None),
    # No equal key: every order against the bands of a table of fixed size
    "b10_theta_join": ("select o_orderkey, n_name from {orders} join {nation} on o_totalprice >= n_nationkey * 20000 and o_totalprice < (n_nationkey + 1) * 20000", None),
    "b13_lateral_join": (
        "select c_custkey, t.o_orderkey, t.o_totalprice from {customer}, lateral (select o_orderkey, o_totalprice from {orders} where o_custkey = c_custkey order by o_totalprice desc, o_orderkey limit 2) t",
        None,
    ),
    "b14_star_join": (
        f"""select r_name, n_name, p_type, count(*) as n, {REVENUE} as revenue
            from {{lineitem}} join {{orders}} on l_orderkey = o_orderkey join {{customer}} on o_custkey = c_custkey join {{part}} on l_partkey = p_partkey
            join {{nation}} on c_nationkey = n_nationkey join {{region}} on n_regionkey = r_regionkey
            where o_orderdate >= timestamp '1996-01-01 00:00:00' group by r_name, n_name, p_type""",
        None,
    ),
    "b15_join_hints": (
        "select /*+ shuffle_hash(o), broadcast(n) */ n_name, count(*) as n from {orders} o join {customer} c on o_custkey = c_custkey join {nation} n on c_nationkey = n_nationkey group by n_name",
        "select n_name, count(*) as n from orders o join customer c on o_custkey = c_custkey join nation n on c_nationkey = n_nationkey group by n_name",
    ),
    "b15_merge_hint": (
        "select /*+ merge(c) */ c_nationkey, count(*) as n from {orders} o join {customer} c on o_custkey = c_custkey group by c_nationkey",
        "select c_nationkey, count(*) as n from orders o join customer c on o_custkey = c_custkey group by c_nationkey",
    ),
    # Copies a table of fixed size to every part of the other
    "b15_replicate_hint": (
        "select /*+ shuffle_replicate_nl(n) */ n_name, count(*) as n from {supplier} s join {nation} n on s_nationkey = n_nationkey group by n_name",
        "select n_name, count(*) as n from supplier s join nation n on s_nationkey = n_nationkey group by n_name",
    ),
    # Aggregation
    "b16_pricing_summary": (
        f"""select l_returnflag, l_linestatus, {MONEY.format("l_quantity")} as sum_qty, {MONEY.format("l_extendedprice")} as sum_base,
                   {REVENUE} as sum_disc, round(avg(l_quantity), 4) as avg_qty, round(stddev_samp(l_quantity), 6) as sd_qty,
                   count(*) as n from {{lineitem}} where l_shipdate <= timestamp '1998-09-02 00:00:00' group by l_returnflag, l_linestatus""",
        None,
    ),
    "b16_median_percentile": (
        "select l_returnflag, round(median(l_quantity), 6) as med, round(percentile_cont(0.9) within group (order by l_extendedprice), 4) as p90 from {lineitem} group by l_returnflag",
        "select l_returnflag, round(median(l_quantity), 6) as med, round(quantile_cont(l_extendedprice, 0.9), 4) as p90 from lineitem group by l_returnflag",
    ),
    "b17_moments": (
        """select l_returnflag, round(corr(l_quantity, l_extendedprice), 6) as r, round(covar_pop(l_quantity, l_discount), 6) as cov, round(var_samp(l_tax), 8) as v,
                  round(skewness(l_quantity), 5) as skew, round(kurtosis(l_quantity), 5) as kurt from {lineitem} group by l_returnflag""",
        """select l_returnflag, round(corr(l_quantity, l_extendedprice), 6) as r, round(covar_pop(l_quantity, l_discount), 6) as cov, round(var_samp(l_tax), 8) as v,
                  round(avg(pow(l_quantity - m, 3)) / pow(avg(pow(l_quantity - m, 2)), 1.5), 5) as skew,
                  round(avg(pow(l_quantity - m, 4)) / pow(avg(pow(l_quantity - m, 2)), 2) - 3, 5) as kurt
           from (select *, avg(l_quantity) over (partition by l_returnflag) as m from lineitem) group by l_returnflag""",
    ),
    "b18_distinct_filter_having": (
        """select user_id, count(distinct event_type) as kinds, count(distinct cast(ts as date)) as days, count(*) filter (where event_type = 'purchase') as bought
           from {events} group by user_id having count(*) > 20""",
        None,
    ),
    "b19_rollup": (
        "select l_returnflag, l_linestatus, cast(grouping(l_linestatus) as bigint) as whole, count(*) as n from {lineitem} group by rollup (l_returnflag, l_linestatus)",
        None,
    ),
    "b19_cube": ("select o_orderstatus, o_orderpriority, count(*) as n from {orders} group by cube (o_orderstatus, o_orderpriority)", None),
    "b19_grouping_sets": ("select n_regionkey, s_nationkey, count(*) as n from {supplier} join {nation} on s_nationkey = n_nationkey group by grouping sets ((n_regionkey), (s_nationkey), ())", None),
    "b20_max_by_lists": (
        """select conv_id, max_by(role, turn) as last_role, min_by(role, turn) as first_role, listagg(role, '>') within group (order by turn) as path, array_join(array_sort(collect_set(role)), ',') as roles
           from {conversations} group by conv_id""",
        """select conv_id, max_by(role, turn) as last_role, min_by(role, turn) as first_role, string_agg(role, '>' order by turn) as path, array_to_string(list_sort(list(distinct role)), ',') as roles
           from conversations group by conv_id""",
    ),
    # Windows
    "b23_ranks": (
        """select s_suppkey, cast(row_number() over w as bigint) as rn, cast(rank() over v as bigint) as rk, cast(dense_rank() over v as bigint) as dr, cast(ntile(4) over w as bigint) as quarter,
                  round(percent_rank() over w, 9) as pr, round(cume_dist() over w, 9) as cd
           from {supplier} window w as (partition by s_nationkey order by s_acctbal, s_suppkey), v as (partition by s_nationkey order by floor(s_acctbal / 1000))""",
        None,
    ),
    "b24_lag_lead_nth": (
        """select event_id, lag(value) over w as before_, lead(value, 2) over w as after_, nth_value(event_type, 2) over f as second_, last_value(event_type) over f as last_
           from {events} window w as (partition by user_id order by ts, event_id), f as (partition by user_id order by ts, event_id rows between unbounded preceding and unbounded following)""",
        None,
    ),
    "b25_rows_frame": (
        """select event_id, cast(sum(cast(value as decimal(18,4))) over w as double) as moving
           from {events} window w as (partition by user_id order by ts, event_id rows between 4 preceding and current row)""",
        None,
    ),
    "b25_range_frame": ("select event_id, count(*) over (partition by user_id order by ts range between interval '6' hour preceding and current row) as recent from {events}", None),
    # Sort and limit
    "b27_top_k": ("select o_orderkey, o_totalprice from {orders} order by o_totalprice desc, o_orderkey limit 25", None),
    "b27_offset": ("select o_orderkey, o_totalprice from {orders} order by o_totalprice desc, o_orderkey limit 20 offset 30", None),
    # Sets
    "b28_union": ("select c_nationkey as k from {customer} union select s_nationkey from {supplier}", None),
    "b28_union_all": ("select c_nationkey as k from {customer} union all select s_nationkey from {supplier}", None),
    "b28_intersect": ("select c_nationkey as k from {customer} where c_acctbal > 0 intersect select s_nationkey from {supplier}", None),
    "b28_intersect_all": ("select l_partkey as k from {lineitem} where l_returnflag = 'A' intersect all select l_partkey from {lineitem} where l_returnflag = 'R'", None),
    "b28_except": ("select p_partkey as k from {part} except select l_partkey from {lineitem} where l_quantity < 10", None),
    "b28_except_all": ("select l_partkey as k from {lineitem} where l_returnflag = 'A' except all select l_partkey from {lineitem} where l_returnflag = 'R'", None),
    # Scalars
    "b29_strings": (
        """select p_partkey, upper(p_name) as up, substr(p_name, 2, 4) as part_, replace(p_type, ' ', '_') as type_, lpad(p_brand, 12, '*') as padded, reverse(p_brand) as back,
                  cast(instr(p_name, 'a') as bigint) as at_, left(p_name, 3) as l3, cast(ascii(p_name) as bigint) as code, repeat(left(p_brand, 1), 3) as r3,
                  translate(p_brand, 'abc', 'xyz') as tr, cast(levenshtein(p_name, p_type) as bigint) as lev, concat_ws('/', p_brand, p_type) as joined from {part}""",
        None,
    ),
    "b30_regexps": (
        r"""select doc_id, regexp_extract(text, '([A-Z][a-z]+)', 1) as first_word, cast(size(regexp_extract_all(text, '([0-9]+)', 1)) as bigint) as numbers,
                   regexp_replace(source, '[0-9]+', '#') as kind, cast(size(split(lang, '[a-f]')) as bigint) as pieces from {documents}""",
        r"""select doc_id, regexp_extract(text, '([A-Z][a-z]+)', 1) as first_word, cast(len(regexp_extract_all(text, '([0-9]+)', 1)) as bigint) as numbers,
                   regexp_replace(source, '[0-9]+', '#', 'g') as kind, cast(len(regexp_split_to_array(lang, '[a-f]')) as bigint) as pieces from documents""",
    ),
    "b31_digests": ("select doc_id, md5(text) as m, sha2(text, 256) as s from {documents}", "select doc_id, md5(text) as m, sha256(text) as s from documents"),
    "b32_math": (
        """select c_custkey, abs(c_acctbal) as a, round(sqrt(abs(c_acctbal)), 9) as q, round(ln(abs(c_acctbal) + 1), 9) as n, cast(floor(c_acctbal) as bigint) as f, cast(ceil(c_acctbal) as bigint) as c,
                  round(power(c_nationkey, 2), 3) as p, cast(sign(c_acctbal) as double) as s, round(c_acctbal, 1) as r from {customer}""",
        None,
    ),
    "b33_dates": (
        """select o_orderkey, cast(year(o_orderdate) as bigint) as y, cast(quarter(o_orderdate) as bigint) as q, cast(month(o_orderdate) as bigint) as m, cast(dayofyear(o_orderdate) as bigint) as d,
                  last_day(o_orderdate) as ld, cast(date_trunc('month', o_orderdate) as timestamp_ntz) as mo, cast(o_orderdate + interval '10' day as timestamp_ntz) as later,
                  date_format(o_orderdate, 'yyyy-MM-dd') as iso, unix_micros(cast(o_orderdate as timestamp)) as us from {orders}""",
        """select o_orderkey, cast(year(o_orderdate) as bigint) as y, cast(quarter(o_orderdate) as bigint) as q, cast(month(o_orderdate) as bigint) as m, cast(dayofyear(o_orderdate) as bigint) as d,
                  last_day(o_orderdate) as ld, cast(date_trunc('month', o_orderdate) as timestamp) as mo, o_orderdate + interval '10' day as later,
                  strftime(o_orderdate, '%Y-%m-%d') as iso, epoch_us(o_orderdate) as us from orders""",
    ),
    "d16_parse_dates": (
        "select o_orderkey, cast(to_timestamp(date_format(o_orderdate, 'dd/MM/yyyy HH:mm'), 'dd/MM/yyyy HH:mm') as timestamp_ntz) as parsed, try_to_timestamp(o_orderpriority, 'yyyy') is null as unparsed from {orders}",
        "select o_orderkey, strptime(strftime(o_orderdate, '%d/%m/%Y %H:%M'), '%d/%m/%Y %H:%M') as parsed, try_strptime(o_orderpriority, '%Y') is null as unparsed from orders",
    ),
    "b34_array_functions": (
        """select vec_id, cast(size(filter(embedding, x -> x > 0)) as bigint) as positive, round(aggregate(transform(embedding, x -> cast(x as double) * x), 0D, (s, x) -> s + x), 5) as norm2,
                  round(cast(element_at(sort_array(embedding), 1) as double), 6) as least from {embeddings}""",
        """select vec_id, cast(len(list_filter(embedding, lambda x: x > 0)) as bigint) as positive, round(list_sum(list_transform(embedding, lambda x: cast(x as double) * x)), 5) as norm2,
                  round(cast(list_min(embedding) as double), 6) as least from embeddings""",
    ),
    "b35_maps": (
        "select event_id, map('click', 1, 'view', 2, 'purchase', 3)[event_type] as code from {events}",
        "select event_id, case event_type when 'click' then 1 when 'view' then 2 when 'purchase' then 3 end as code from events",
    ),
    "b36_json": (
        "select event_id, cast(get_json_object(props, '$.k') as bigint) as k, from_json(props, 'k bigint').k as k2, variant_get(parse_json(props), '$.k', 'bigint') as k3 from {events}",
        "select event_id, cast(props->>'$.k' as bigint) as k, cast(props->>'$.k' as bigint) as k2, cast(props->>'$.k' as bigint) as k3 from events",
    ),
    "b37_url_parts": (
        "select page_id, parse_url(url, 'HOST') as host, coalesce(parse_url(url, 'QUERY'), '') as query from {pages}",
        "select page_id, regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1) as host, regexp_extract(url, '\\?([^#]*)', 1) as query from pages",
    ),
    # Subqueries and common tables
    "b38_correlated_scalar": ("select o_orderkey from {orders} o where o_totalprice > (select 1.5 * avg(o_totalprice) from {orders} i where i.o_custkey = o.o_custkey)", None),
    "b38_exists": ("select s_suppkey, s_name from {supplier} where exists (select 1 from {lineitem} where l_suppkey = s_suppkey and l_quantity > 49)", None),
    "b38_recursive": (
        """with recursive chain(k, depth, top) as (select n_nationkey, 0, n_nationkey from {nation} where n_regionkey = 0
             union all select n.n_nationkey, c.depth + 1, c.top from chain c join {nation} n on n.n_nationkey = c.k + 1 where c.depth < 3)
           select top, max(depth) as deepest, count(distinct k) as nations, count(*) as customers from chain join {customer} on c_nationkey = k group by top""",
        None,
    ),
    # Time windows over a batch
    "b39_tumbling": (
        "select cast(window.start as timestamp_ntz) as start_, event_type, count(*) as n, cast(sum(cast(value as decimal(18,4))) as double) as total from (select window(ts, '1 hour') as window, * from {events}) group by window.start, event_type",
        "select time_bucket(interval '1 hour', ts) as start_, event_type, count(*) as n, cast(sum(cast(value as decimal(18,4))) as double) as total from events group by 1, 2",
    ),
    "b40_sliding": (
        "select cast(w.start as timestamp_ntz) as start_, count(*) as n from (select window(ts, '1 hour', '15 minutes') as w from {events}) group by w.start",
        """select b as start_, count(*) as n from (select unnest([time_bucket(interval '15 minutes', ts) - k * interval '15 minutes' for k in range(4)]) as b from events) group by 1""",
    ),
    "b41_sessions": (
        "select user_id, cast(w.start as timestamp_ntz) as start_, n from (select user_id, session_window(ts, '2 hours') as w, count(*) as n from {events} group by user_id, session_window(ts, '2 hours'))",
        """select user_id, min(ts) as start_, count(*) as n from (
             select *, sum(new) over (partition by user_id order by ts, event_id) as s from (
               select *, case when ts - lag(ts) over (partition by user_id order by ts, event_id) < interval '2 hours' then 0 else 1 end as new from events)) group by user_id, s""",
    ),
    # Text
    "b52_word_counts": (
        # A row gives each word for its places and once for itself, so only words and two sums are shuffled
        r"""select word, sum(place) as n, sum(doc) as docs from (select regexp_extract_all(lower(text), '[a-z]+', 0) as words from {documents})
            lateral view inline(concat(transform(words, w -> named_struct('word', w, 'place', 1, 'doc', 0)), transform(array_distinct(words), w -> named_struct('word', w, 'place', 0, 'doc', 1)))) t as word, place, doc group by word""",
        r"select word, count(*) as n, count(distinct doc_id) as docs from (select doc_id, unnest(regexp_extract_all(lower(text), '[a-z]+')) as word from documents) group by word",
    ),
}
