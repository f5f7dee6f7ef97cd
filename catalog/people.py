"""The user directory."""

from pyspark.sql import functions as F

from catalog import base_sql as b
from catalog.registry import big, ctes, num, query, when
from catalog.shapes import Shapes
from sessionlens.operators import directory
from sessionlens.session import fresh_path
from sessionlens.sources import people as people_files

_profile = 'usr AS "user", uname, email, role, b_unit, f_unit, dept, team, sup_name'


@query("directory_scan", ctes(b.SNAPSHOTS) + f" SELECT month, {_profile} FROM snapshots")
def directory_scan(s: Shapes):
    """Monthly snapshots written as CSV and read back; the month comes from the path."""
    path = fresh_path(s.spark, "snapshots")
    rows = s.snapshots().select(*people_files.SNAPSHOT_COLUMNS, "month")
    rows.write.partitionBy("month").options(**people_files.CSV_OPTIONS).csv(path)
    return people_files.read_snapshots(s.spark, path).select("month", "user", *directory.PROFILE)


@query("directory_enrich", ctes(*b.PEOPLE) + f" SELECT {_profile}, wstart, wend, "
       + ", ".join(num(f'"{t}"', t) for t in directory.TRAITS) + " FROM dir")
def directory_enrich(s: Shapes):
    whole = directory.directory(s.snapshots(), s.traits())
    return whole.select("user", *directory.PROFILE, "wstart", "wend", *directory.TRAITS)


@query("employment_span", ctes(b.SNAPSHOTS, b.SPANS) + ' SELECT usr AS "user", wstart, wend FROM spans')
def employment_span(s: Shapes):
    return directory.employment_span(s.snapshots())


@query("supervisor_resolve", ctes(*b.PEOPLE) + ' SELECT usr AS "user", sup_name, sup FROM dir')
def supervisor_resolve(s: Shapes):
    whole = directory.directory(s.snapshots(), s.traits())
    return directory.resolve_supervisor(whole).select("user", "sup_name", "sup")


@query("user_pcs", ctes(*b.LOGS, *b.PEOPLE, b.PCS) + " SELECT usr AS \"user\", array_to_string(pcs, ',') AS pcs FROM pcs")
def user_pcs(s: Shapes):
    return directory.user_pcs(s.weeks)


@query("primary_pc", ctes(*b.LOGS, *b.PEOPLE, b.PCS) + ' SELECT usr AS "user", pc FROM own')
def primary_pc(s: Shapes):
    return directory.primary_pc(directory.user_pcs(s.weeks)).select("user", "pc")


@query("shared_pcs", ctes(*b.LOGS, *b.PEOPLE, b.PCS) + """
SELECT o.usr AS "user", o.pc, string_agg(s.pc, ',' ORDER BY s.pc) AS sharedpc
FROM own o LEFT JOIN shared s ON o.usr = s.usr GROUP BY o.usr, o.pc""")
def shared_pcs(s: Shapes):
    return directory.shared_pcs(directory.primary_pc(directory.user_pcs(s.weeks)), s.people)


@query("malicious_acts", ctes(*b.PEOPLE, b.ANSWERS) + f"""
SELECT d.usr AS "user", {big('coalesce(i.scenario, 0)', 'malscene')}, {when('i.mstart', 'mstart')}, {when('i.mend', 'mend')},
       {big('(SELECT count(*) FROM pairs p WHERE p.usr = d.usr)', 'n_malacts')},
       (SELECT string_agg(actid, ',' ORDER BY actid) FROM pairs p WHERE p.usr = d.usr) AS malacts
FROM dir d LEFT JOIN insiders i ON d.usr = i.usr""")
def malicious_acts(s: Shapes):
    """Insider intervals from the answer index (written as CSV and read back) and the action list."""
    path = fresh_path(s.spark, "answers")
    s.answers().write.options(**people_files.CSV_OPTIONS).csv(path)
    insiders = directory.insider_index(people_files.read_answers(s.spark, path))
    pairs = directory.malicious_pairs(insiders, people_files.parse_answer_details(s.details()))
    acts = pairs.groupBy("user").agg(
        F.count(F.lit(1)).alias("n_malacts"), F.sort_array(F.collect_list("id")).alias("malacts"))
    people = directory.with_insider_interval(s.people.select("user"), insiders)
    return people.join(acts, "user", "left").select(
        "user", "malscene", "mstart", "mend", F.coalesce("n_malacts", F.lit(0)).alias("n_malacts"), "malacts")


@query("user_index", ctes(*b.PEOPLE, b.CODES) + f' SELECT usr AS "user", {big("user_int", "user_int")} FROM uidx')
def user_index(s: Shapes):
    return directory.user_index(s.people)


@query("user_static", ctes(*b.PEOPLE, b.CODES) + ' SELECT usr AS "user", ' + ", ".join(
    [big(f'"{c}"', c) for c in [*directory.STATIC_COLUMNS, "ITAdmin"]] + [num(f'"{t}"', t) for t in directory.TRAITS]) + " FROM static")
def user_static(s: Shapes):
    return directory.user_static(s.people)


@query("ordinal_encode", ctes(*b.PEOPLE, b.CODES) + f"""
SELECT d.usr AS "user", {big('c_dept.code', 'dept')}, {big('c_role.code', 'role')}
FROM dir d JOIN code_dept c_dept ON d.dept = c_dept.v JOIN code_role c_role ON d.role = c_role.v""")
def ordinal_encode(s: Shapes):
    return directory.ordinal_encode(s.people.select("user", "dept", "role"), ["dept", "role"])
