"""Settings and package manifests of repositories: a customer is a repository, its orders are files and scripts.

The texts hold comments and trailing commas. The SQL parses them again and follows parents by a recursive query.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.operators import configs, entries
from evidentia.tables import table

MAX_FILES, MAX_BYTES = 12, 1500
# What follows reads alike in Spark and in DuckDB.
_FILES = """select c as root, case when n = 1 then 'tsconfig.json' else concat('cfg/', cast(n as string), '.json') end as path,
  case when c % 23 = 5 and n = m then '{"extends": ' else concat(case when k % 3 = 0 then concat('// settings of "', cast(k as string), chr(10)) else '' end, '{',
    case when n < m and n = 1 then '"extends": "./cfg/2",' when n < m then concat('"extends": "./', cast(n + 1 as string), case when k % 2 = 0 then '.json' else '' end, '",')
      when c % 23 = 1 and n = 1 then '"extends": "./tsconfig",' when c % 23 = 1 then '"extends": "../tsconfig.json",' when c % 23 = 2 then '"extends": "shared",'
      when c % 23 = 3 then '"extends": "../../x",' when c % 23 = 4 then '"extends": "./gone",' else '' end,
    ' "compilerOptions": {', case when k % 5 = 0 then concat('"baseUrl": "./b', cast(k % 3 as string), '" /* base */,') else '' end,
    case when k % 4 <> 0 then concat('"paths": {"@p', cast(k % 7 as string), '/*": ["src/', cast(k % 9 as string), '/*", "../lib/*"], "u', cast(k % 3 as string), '": ["u.ts"],}') else '' end, '}}') end as raw
  from (select o_custkey as c, o_orderkey as k, row_number() over (partition by o_custkey order by o_orderkey) as n, count(*) over (partition by o_custkey) as m from orders) as x"""
_KNOWN = "select distinct o_custkey as root, concat('src/o', cast(o_orderkey % 50 as string), case when o_orderkey % 4 = 0 then '.ts' else '/index.tsx' end) as path from orders where o_orderkey % 2 = 0"
_SCRIPT = """case o_orderkey % 6 when 0 then concat('"tsx src/o', cast(o_orderkey % 50 as string), '"') when 1 then '"node a && b"' when 2 then '"tsx -v x"'
  when 3 then concat('"bun run ./src/o', cast((o_orderkey + 1) % 50 as string), '.ts"') when 4 then '1' else '"make all the things"' end"""
_REST = """concat('}', case root % 5 when 0 then ', "bin": "../up"' when 1 then concat(', "bin": {"b', cast(last_key as string), '": "src/o', cast(last_key % 50 as string), '", "c": 5}') when 2 then ', "bin": 7' else '' end,
  case root % 3 when 0 then concat(', "main": "src/o', cast(last_key % 50 as string), '.js"') when 1 then ', "module": []' else '' end, case when root % 11 = 0 then '' else '}' end)"""


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    table(spark, sf_dir, "orders").createOrReplaceTempView("orders")
    return spark.sql(_FILES)


def settings_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the settings of every repository come to, or why they could not be read."""
    return configs.effective_settings(_files(spark, sf_dir), MAX_FILES, MAX_BYTES)[0].drop("effective_fingerprint")


def settings_mappings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The path mappings that hold in every repository, of chains of any length."""
    return configs.effective_settings(_files(spark, sf_dir), None, None, None, None)[1]


def package_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The entries that every repository's manifest names, and the file of the repository that each leads to."""
    table(spark, sf_dir, "orders").createOrReplaceTempView("orders")
    scripts = spark.sql(f"""select o_custkey as root, o_orderkey as k, concat('"o', cast(o_orderkey as string), '": ', {_SCRIPT}) as s from orders""")
    held = scripts.groupBy("root").agg(F.array_join(F.array_sort(F.collect_list("s")), ", ").alias("s"), F.max("k").alias("last_key"))
    raw = F.concat(F.lit('{"scripts": {'), "s", F.expr(_REST))
    _, found = configs.package_entries(held.select("root", raw.alias("raw")))
    placed = entries.resolve_targets(found.where("reason is null").drop("reason"), spark.sql(_KNOWN), by=("root",))
    return placed.unionByName(found.where("reason is not null"), allowMissingColumns=True)


_DUCK = lambda text: text.replace("as string)", "as varchar)")
_CHAINS = rf"""with recursive f as ({_DUCK(_FILES)}),
  s as (select root, path, raw, strlen(raw) as bytes, regexp_replace(regexp_replace(raw, '("[^"]*")|//[^\n]*|/\*.*?\*/', '\1', 'gs'), ',(\s*[}}\]])', '\1', 'g') as j, regexp_replace(path, '/?[^/]*$', '') as folder from f),
  d as (select root, path, raw, bytes, folder, json_valid(j) as valid, case when json_valid(j) then json(j) end as j from s),
  e as (select *, json_extract_string(j, '$.extends') as x, json_extract_string(j, '$.compilerOptions.baseUrl') as b, json_extract(j, '$.compilerOptions.paths') as p from d),
  g as (select *, case when x = 'shared' then 'tsconfig-package-extends-unsupported' when x = '../../x' then 'tsconfig-extends-escapes-repository' end as refused,
    case when x = '../tsconfig.json' then 'tsconfig.json' when x like './%' then case when folder = '' then '' else folder || '/' end || x[3:] || case when x like '%.json' then '' else '.json' end end as parent from e),
  v(root, position, path, seen, total) as (select root, 0, path, cast([] as varchar[]), cast(0 as hugeint) from g where path = 'tsconfig.json'
    union all select v.root, v.position + 1, g.parent, list_append(v.seen, v.path), v.total + g.bytes from v join g on g.root = v.root and g.path = v.path
      where g.valid and g.refused is null and g.parent is not null and not list_contains(v.seen, v.path) and v.position < {MAX_FILES} and v.total + g.bytes <= {MAX_BYTES}),
  w as (select v.root, position, v.path, g.raw, g.bytes, g.folder, b, p, case when list_contains(seen, v.path) then 'tsconfig-extends-cycle:' || v.path when position >= {MAX_FILES} then 'tsconfig-files-capped-at-{MAX_FILES}'
      when g.path is null then 'tsconfig-read-failed:' || v.path when total + g.bytes > {MAX_BYTES} then 'tsconfig-bytes-capped-at-{MAX_BYTES}' when not g.valid then 'tsconfig-invalid-jsonc:' || v.path else g.refused end as reason,
    not list_contains(seen, v.path) and position < {MAX_FILES} and g.path is not null as held from v left join g on g.root = v.root and g.path = v.path),
  h as (select *, case when b is not null then case when folder = '' then '' else folder || '/' end || b[3:] end as base from w where held),
  n as (select *, last_value(base ignore nulls) over u as holds, last_value(case when base is not null then path end ignore nulls) over u as holds_at from h window u as (partition by root order by position desc rows between unbounded preceding and current row)),
  o as (select *, coalesce(holds, folder) as here, case when p is not null and coalesce(holds, folder) = '' then 'tsconfig-path-escapes-repository' end as fault from n),
  r as (select root, cast(count(*) as integer) as n_files, string_agg(path, ',' order by path) as files, arg_min_null(holds, position) as base_url, arg_min_null(holds_at, position) as base_origin,
    arg_max(fault, position) filter (where fault is not null) as fault, sha256('files' || chr(0) || string_agg(path || chr(0) || bytes || chr(0) || sha256(raw), chr(0) order by path)) as exact_fingerprint,
    min(position) filter (where p is not null) as wins from o group by root),
  q as (select root, arg_max_null(reason, position) as reason from w group by root),
  t as (select r.*, coalesce(q.reason, r.fault) as reason from r join q on q.root = r.root)"""
# The same without the bounds on files and bytes.
_WHOLE_CHAINS = _CHAINS.replace(f" and v.position < {MAX_FILES} and v.total + g.bytes <= {MAX_BYTES}", "").replace(f" when position >= {MAX_FILES} then 'tsconfig-files-capped-at-{MAX_FILES}'", "")
_WHOLE_CHAINS = _WHOLE_CHAINS.replace(f" when total + g.bytes > {MAX_BYTES} then 'tsconfig-bytes-capped-at-{MAX_BYTES}'", "").replace(f" and position < {MAX_FILES} and g.path is not null as held", " and g.path is not null as held")
QUERIES = {"settings_chains": settings_chains, "settings_mappings": settings_mappings, "package_entries": package_entries}
ORACLES = {
    "settings_chains": _CHAINS
    + """ select root, case when reason is null then 'complete' when contains(reason, 'capped') then 'truncated' else 'unavailable' end as status, reason, n_files, files,
      case when reason is null then base_url end as base_url, case when reason is null then base_origin end as base_origin, exact_fingerprint from t""",
    "settings_mappings": _WHOLE_CHAINS
    + """, k as (select o.root, o.path as origin, here, p, unnest(json_keys(p)) as pattern from t join o on o.root = t.root and o.position = t.wins where t.reason is null),
      y as (select root, origin, here, pattern, cast(json_extract(p, '$."' || pattern || '"') as varchar[]) as targets from k), z as (select *, unnest(range(0, len(targets))) as i from y)
      select root, pattern, cast(i as integer) as target_order, case when starts_with(targets[i + 1], '../') then case when contains(here, '/') then regexp_replace(here, '/[^/]*$', '') || '/' else '' end || targets[i + 1][4:]
        else case when here = '' then '' else here || '/' end || targets[i + 1] end as target, origin from z""",
    "package_entries": f"""with k as ({_DUCK(_KNOWN)}), a as (select o_custkey as root, max(o_orderkey) as last_key, string_agg('"o' || o_orderkey || '": ' || {_DUCK(_SCRIPT)}, ', ') as s from orders group by o_custkey),
      m as (select root, json(raw) as j from (select root, '{{"scripts": {{' || s || {_DUCK(_REST)} as raw from a) where json_valid(raw)),
      r as (select root, 'script' as kind, unnest(json_keys(j, '$.scripts')) as key, j from m union all select root, 'bin', unnest(case when json_type(j, '$.bin') = 'OBJECT' then json_keys(j, '$.bin') else ['bin'] end), j from m where json_exists(j, '$.bin')
        union all select root, 'main', 'main', j from m where json_exists(j, '$.main') union all select root, 'module', 'module', j from m where json_exists(j, '$.module')),
      v as (select root, kind, key, json_extract(j, case when kind = 'script' then '$.scripts.' || key when kind = 'bin' and json_type(j, '$.bin') = 'OBJECT' then '$.bin.' || key else '$.' || kind end) as v, json_type(j, '$.bin') as bin from r),
      x as (select root, kind, key, bin, case when json_type(v) = 'VARCHAR' then json_extract_string(v, '$') end as t from v),
      y as (select root, kind, key, case when t like 'tsx src%' then 'tsx' when t like 'bun run %' then 'bun run' end as runner, case when kind <> 'script' then t when t like 'tsx src%' then t[5:] when t like 'bun run %' then t[9:] end as target,
        case when kind = 'script' then case when t is null then 'script-command-not-literal' when contains(t, '&&') then 'script-command-complex-or-shell-composed' when contains(t, ' -v') then 'script-command-flags-or-quoting-unsupported' when t like 'make%' then 'unsupported-script-runner-or-arity' end
          when t is null then case when kind = 'bin' and bin = 'OBJECT' then 'bin-target-not-string' when kind = 'bin' then 'bin-not-string-or-object' else 'entry-target-not-string' end end as why from x),
      c as (select y.*, case when starts_with(target, './') then target[3:] else target end as t from y),
      z as (select c.*, coalesce(k1.path, k2.path, k3.path) as found from c left join k k1 on k1.root = c.root and k1.path = c.t left join k k2 on k2.root = c.root and k2.path = c.t || '.ts' left join k k3 on k3.root = c.root and k3.path = c.t || '/index.tsx' and not contains(c.t, '.'))
      select root, kind, key, runner, target, case when why is null and not starts_with(t, '..') and not ends_with(t, '.js') then found end as path,
        coalesce(why, case when starts_with(t, '..') then 'entry-target-escapes-repository' when ends_with(t, '.js') then 'entry-target-javascript-output-unsupported' when found is null then 'entry-target-missing-or-not-typescript' else 'entry-target-resolved' end) as reason from z""",
}
