"""Queries of the requirement language: nested specs, ways to ask, fields in ``extra``, flags and reports, with their SQL."""
from __future__ import annotations

from pyspark.sql import functions as F

from rostrum.operators import requirements as R
from rostrum.plans import fixtures as X
from rostrum.plans.catalogue import query

_ROWS = """select c_custkey, case when c_custkey % 9 = 0 then 0.0e0 when c_custkey % 9 < 8 then cast(c_custkey % 9 as double) end as years_experience, c_mktsegment as segment,
concat('{{"clearance": "', lower(c_mktsegment), '", "team size": ', c_custkey % 4, ', "langs": ', case c_custkey % 3 when 0 then '["French", "German"]' when 1 then '"french"' else '[]' end, ', "remote": ', case when c_custkey % 2 = 0 then 'true' else 'false' end,
', "visa": {{"status": "', case when c_custkey % 5 = 0 then 'open' else 'permit' end, '"}}}}') as json from {customer}"""


def _rows(s, d):
    return X.view(s, d, _ROWS).withColumn("extra", F.try_parse_json("json")).drop("json")


NESTED = {"requirements": [
    {"type": "years", "data": {"value": 2, "unit": "y"}}, {"type": "text", "data": {"type": "text", "required": "x"}},
], "clearance": "Build", "langs": ["french"], "team size": {"min": 1, "max": 2}, "remote": {"type": "boolean", "required": True}, "visa.status": {"type": "text", "required": "permit"}, "nowhere": {"type": "text", "required": "z"}, "nothing": [], "unsaid": {"type": "list", "specified": True, "required": [], "optional": []}}
_FACTS = """f as (select c_custkey, case when c_custkey % 9 < 8 then c_custkey % 9 end as y, c_mktsegment as segment, c_custkey % 4 as team, c_custkey % 3 <> 2 as french, c_custkey % 2 = 0 as remote, c_custkey % 5 <> 0 as permit from customer)"""


@query("requirement_extra", f"""with {_FACTS}, m as (select *, segment ilike '%build%' as c, coalesce(y >= 2, false) as e, team between 1 and 2 as t from f)
select c_custkey, concat_ws(',', case when c then 'clearance' end, case when e then 'experience' end, case when french then 'langs' end, case when remote then 'remote' end, case when t then 'team size' end, case when permit then 'visa.status' end) as met,
concat_ws('; ', case when not c then concat('clearance: clearance: ', chr(39), lower(segment), chr(39), ' (required: ', chr(39), 'Build', chr(39), ')') end,
  case when e then null when y is null then 'experience: experience not found in resume' else concat('experience: experience: ', y, '.0y (required: 2-unlimitedy)') end,
  case when not french then 'langs: langs: Found 0/1 required. Missing: french' end, 'nowhere: nowhere not found in resume', case when not remote then 'remote: remote: False (required: True)' end,
  case when not t then concat('team size: team size: ', team, '.0 (required: 1-2)') end, 'text: text not found in resume', case when not permit then concat('visa.status: visa.status: ', chr(39), 'open', chr(39), ' (required: ', chr(39), 'permit', chr(39), ')') end) as reasons,
(cast(c as int) + cast(e as int) + cast(french as int) + cast(remote as int) + cast(t as int) + cast(permit as int)) / 8e0 as score from m""")
def requirement_extra(s, d):
    """Nested requirements laid flat; fields are columns, keys and paths of ``extra``."""
    c = R.compliance(_rows(s, d), R.flat_requirements(NESTED))
    return c.select("c_custkey", F.array_join("met", ",").alias("met"), R.reason(99).alias("reasons"), "score")


#: Specs that the five ways to ask take differently: only optional items, nothing but a type, a bound that is missing, nothing said.
ODD = {
    "langs": {"type": "list", "specified": True, "required": [], "optional": ["french"]}, "segment": {"type": "text", "specified": True, "required": ""}, "years_experience": {"type": "numeric", "specified": True},
    "clearance": {"type": "text"}, "remote": {"specified": False}, "visa.status": {"type": "text", "specified": True, "required": "permit"},
}
_ASKED = {"filter": 3, "skip": 5, "form": 5, "rerank": 5, "rank": 2}


def _mode(mode: str) -> None:
    @query(f"requirement_mode_{mode}", f"with {_FACTS} select c_custkey, case when permit then 'visa.status' else '' end as met, case when permit then '' else 'visa.status' end as missing, cast(permit as int) / {_ASKED[mode]}e0 as score from f")
    def run(s, d):
        c = R.compliance(_rows(s, d), ODD, mode)
        return c.select("c_custkey", F.array_join("met", ",").alias("met"), F.array_join("missing", ",").alias("missing"), "score")


for _m in R.MODES:
    _mode(_m)


@query("requirement_flags", f"""with {_FACTS} select c_custkey, coalesce(y between 0 and 4, false) as live, coalesce(y between 1 and 4, false) as zero_missing, y is not null as no_max,
case when coalesce(y, 0) = 0 then 'years_experience not found in resume' else concat('years_experience: ', y, '.0 (required: 0-4)') end as why from f""")
def requirement_flags(s, d):
    """Years of 0 to 4: as they stand, with 0 as no statement, and without the upper bound."""
    rows, spec = _rows(s, d), {"type": "numeric", "min": 0, "max": 4}
    check = lambda **flags: R.check(rows, "years_experience", spec, **flags)
    return rows.select("c_custkey", check()[0].alias("live"), check(zero_is_missing=True)[0].alias("zero_missing"), check(enforce_max=False)[0].alias("no_max"), check(zero_is_missing=True)[1].alias("why"))


@query("experience_report", f"""with {_FACTS} select c_custkey, coalesce(y between 2 and 5, false) as meets, case when y is null then 'missing' when y < 2 then 'below' when y > 5 then 'exceeds' else 'exact' end as match_quality,
case when y is null then 'Experience not specified in resume' else concat('Candidate has ', y, '.0 years (required: 2-5 years in data)') end as details from f""")
def experience_report(s, d):
    r = _rows(s, d).select("c_custkey", R.experience_report(F.col("years_experience"), 2, 5, "data").alias("r"))
    return r.select("c_custkey", "r.*")


@query("optional_items", f"with {_FACTS} select c_custkey, french as met, case when c_custkey % 3 = 0 then 'german' else '' end as optional from f")
def optional_items(s, d):
    met, _, optional = R.check(_rows(s, d), "langs", {"type": "list", "required": ["French"], "optional": ["German", "Polish"]})
    return _rows(s, d).select("c_custkey", met.alias("met"), F.array_join(optional, ",").alias("optional"))
