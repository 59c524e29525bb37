"""Tables of a data folder, and the views over them that stand for notes, links and history.

The view texts run unchanged on Spark and on DuckDB.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

VIEWS = {
    "notes": """select concat('articles/d', cast(d.doc_id as varchar(20))) as id,
       concat('articles/d', cast(d.doc_id as varchar(20)), '.md') as path,
       concat('Document ', cast(d.doc_id as varchar(20))) as title,
       d.doc_id as note_idx, d.lang as tag_lang, d.source as tag_source, d.n_chars,
       l.quality, l.toxic, d.text as content
from documents d left join labels l on d.doc_id = l.doc_id""",
    "raw_links": """select concat('parts/p', cast(a.l_partkey as varchar(20)), '.md') as source,
       concat('parts/p', cast(b.l_partkey as varchar(20)), '.md') as target,
       a.l_orderkey as line
from lineitem a join lineitem b on a.l_orderkey = b.l_orderkey and a.l_linenumber < b.l_linenumber""",
    "links": """select concat('parts/p', cast(a.l_partkey as varchar(20)), '.md') as source,
       concat('parts/p', cast(b.l_partkey as varchar(20)), '.md') as target,
       min(a.l_orderkey) as line
from lineitem a join lineitem b
  on a.l_orderkey = b.l_orderkey and a.l_linenumber < b.l_linenumber and a.l_partkey <> b.l_partkey
group by a.l_partkey, b.l_partkey""",
    "sparse_links": """select concat('parts/p', cast(a.l_partkey as varchar(20)), '.md') as source,
       concat('parts/p', cast(b.l_partkey as varchar(20)), '.md') as target,
       min(a.l_orderkey) as line
from lineitem a join lineitem b
  on a.l_orderkey = b.l_orderkey and a.l_linenumber < b.l_linenumber and a.l_partkey <> b.l_partkey
where a.l_returnflag = 'R' and b.l_returnflag = 'R' and a.l_quantity >= 40 and b.l_quantity >= 40
group by a.l_partkey, b.l_partkey""",
    "part_notes": """select concat('parts/p', cast(p_partkey as varchar(20))) as id,
       concat('parts/p', cast(p_partkey as varchar(20)), '.md') as path, p_name as title,
       p_partkey as note_idx, p_brand as tag_brand, p_type as tag_type from part""",
    "relations": """select distinct concat('suppliers/s', cast(l_suppkey as varchar(20))) as source,
       case l_returnflag when 'R' then 'returned-by' when 'A' then 'accepted-by' else 'supplies' end as predicate,
       concat('parts/p', cast(l_partkey as varchar(20))) as target
from lineitem""",
    "scopes": """select concat('suppliers/s', cast(s.s_suppkey as varchar(20))) as id, r.r_name as scope
from supplier s join nation n on s.s_nationkey = n.n_nationkey join region r on n.n_regionkey = r.r_regionkey
where s.s_suppkey % 2 = 0
union all
select concat('suppliers/s', cast(s.s_suppkey as varchar(20))), concat(r.r_name, '/', n.n_name)
from supplier s join nation n on s.s_nationkey = n.n_nationkey join region r on n.n_regionkey = r.r_regionkey
where s.s_suppkey % 3 <> 0""",
    "targets": """select concat(r.r_name, '/', n.n_name, '/', c.c_name) as target
from customer c join nation n on c.c_nationkey = n.n_nationkey join region r on n.n_regionkey = r.r_regionkey""",
    "commits": "select o_orderkey as hash, o_orderdate as committed_at, o_orderpriority as subject from orders",
    "commit_paths": "select distinct l_orderkey as hash, concat('parts/p', cast(l_partkey as varchar(20)), '.md') as path from lineitem",
    "thread": "select conv_id, turn, case when turn = 0 then null else turn - 1 end as parent_turn, role, text from conversations",
    "qrels": """select b.item_id as query_id, d.doc_id, 3 as relevance
from benchmark b join documents d on contains(d.text, b.text)""",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of a data folder.

    The session no longer takes a union's partitioning from its branches: Spark 4.1 does so though adaptive execution may coalesce each
    branch in its own way, and a grouping above then gives one key several rows.
    """
    spark.conf.set("spark.sql.unionOutputPartitioning", "false")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view by name, over the tables of one folder."""
    tables = {t: table(spark, sf_dir, t) for t in TABLES if f" {t} " in f" {VIEWS[name]} ".replace("\n", " ")}
    text = VIEWS[name]
    for t in tables:
        text = text.replace(f"from {t}", f"from {{{t}}}").replace(f"join {t}", f"join {{{t}}}")
    return spark.sql(text, **tables)


def with_views(sql: str, *names: str) -> str:
    """DuckDB SQL with the views as leading common table expressions."""
    return "with " + ",\n".join(f"{n} as ({VIEWS[n]})" for n in names) + sql
