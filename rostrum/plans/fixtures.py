"""Adapter views: the warehouse tables read as candidates, projects and skills. The text runs in Spark and in DuckDB."""
from pyspark.sql import DataFrame, SparkSession

CAND = """
select concat('cand_', lpad(cast(c_custkey as string), 9, '0')) as candidate_id, max(c_name) as name,
       max(n_name) as location, max(c_mktsegment) as segment,
       cast(case when c_custkey % 17 = 0 then null
                 else max(year(o_orderdate)) - min(year(o_orderdate)) end as double) as years_experience
from {customer} join {nation} on c_nationkey = n_nationkey left join {orders} on o_custkey = c_custkey
group by c_custkey"""

PROJ = """
select concat('cand_', lpad(cast(o_custkey as string), 9, '0')) as candidate_id, o_orderkey as project_id,
       avg(l_quantity) / 50 as difficulty, avg(l_discount) * 10 as novelty,
       avg(l_tax) / cast(0.08 as double) as skill_relevance,
       case when count(l_orderkey) > 0
            then least(count(l_orderkey) / cast(7 as double), cast(1 as double)) end as complexity,
       avg(case when l_returnflag = 'R' then 1.0e0 when l_returnflag is not null then 0.0e0 end) as technical_depth,
       case when o_orderpriority <> '4-NOT SPECIFIED'
            then avg(case when l_linestatus = 'O' then 1.0e0 when l_linestatus is not null then 0.0e0 end) end as domain_relevance,
       case when count(l_orderkey) > 0 then case o_orderpriority when '1-URGENT' then 1.0e0 when '2-HIGH' then 0.75e0
            when '3-MEDIUM' then 0.5e0 when '5-LOW' then 0.25e0 end end as execution_quality
from {orders} left join {lineitem} on l_orderkey = o_orderkey
group by o_custkey, o_orderkey, o_orderpriority"""

CSKILL = """
select distinct concat('cand_', lpad(cast(o_custkey as string), 9, '0')) as candidate_id, lower(x.skill) as skill
from {orders} join {lineitem} on l_orderkey = o_orderkey
join (select p_partkey, p_brand as skill from {part} union all select p_partkey, p_type as skill from {part}) x
  on x.p_partkey = l_partkey"""

#: Skills of candidates, repeated: sets are made of these, so that one shuffle does for both.
SKILLS = CSKILL.replace("select distinct", "select", 1)

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SECTION_NAMES = ("skills", "projects", "responsibilities", "profile", "education", "overall")

JD_REQUIRED = ["brand#1", "brand#12", "brand#25", "promo", "brand#99"]
JD_PREFERRED = ["economy", "brand#7"]
JD_WEIGHTED = {"brand#3": 0.9, "brand#4": 0.6, "large": 0.3, "zzz": 0.2}
MANDATORY = {"experience": {"type": "numeric", "min": 1, "max": 5}, "hard_skills": {"type": "list", "required": ["promo", "brand#1"]}}
SOFT = {"location": {"type": "location", "required": "x", "allowed": ["NATION_1", "NATION_2"]}, "segment": {"type": "text", "required": "BUILDING"}}
DEGREES = {"HOUSEHOLD": "High School", "FURNITURE": "Bachelor's", "BUILDING": "Master's", "MACHINERY": "PhD"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    used = {t: table(spark, sf_dir, t) for t in TABLES if "{" + t + "}" in sql}
    return spark.sql(sql, **used)


def sql_text(sql: str) -> str:
    for t in TABLES:
        sql = sql.replace("{" + t + "}", t)
    return sql
