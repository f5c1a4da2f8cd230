"""All queries over the test tables, by name, and the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lemmaworks.functions import latex as L
from lemmaworks.operators import attach as A
from lemmaworks.operators import closure as G
from lemmaworks.operators import curate as C
from lemmaworks.operators import explore as X
from lemmaworks.operators import hierarchy as H
from lemmaworks.operators import pairs as P
from lemmaworks.operators import retrieval as R

FLAGSHIP = "mined_pairs"


def read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def statements(spark, d) -> DataFrame:
    """Statements, repeated rows once."""
    return read(spark, d, "statements").drop("ingested_at").dropDuplicates(["stmt_id"])


def proofs(spark, d) -> DataFrame:
    return read(spark, d, "proofs").drop("ingested_at").dropDuplicates(["proof_id"])


def pairs(spark, d) -> DataFrame:
    return read(spark, d, "pairs").drop("ingested_at").dropDuplicates(["pair_id"])


STMT = "s as (select distinct on (stmt_id) * from statements), "
PRF = "p as (select distinct on (proof_id) * from proofs), "
PAIR = "q as (select distinct on (pair_id) * from pairs), "

_Q: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(f):
        _Q[name] = f
        if sql is not None:
            _SQL[name] = sql
        return f

    return keep


_EDGES = r"""with recursive n as (select distinct stmt_id as id from trees where stmt_id is not null),
  raw as (select stmt_id as src, regexp_replace(e, '^\s+|\s+$', '', 'g') as e, min(pos) as pos from (select stmt_id, unnest(depends_on) as e, unnest(range(len(depends_on))) as pos from trees) where e is not null group by 1, 2),
  edge as (select src, dst, min(pos) as pos from (select src, coalesce(a.id, b.id) as dst, pos from raw left join n a on a.id = raw.e left join n b on b.id = (case when contains(raw.src, '::') then split_part(raw.src, '::', 1) else raw.src end) || '::' || raw.e
           where raw.e <> '') where dst is not null group by 1, 2),
"""
_UP = _EDGES + """
  par as (select src as id, arg_min(dst, struct_pack(p := pos, d := dst)) as parent from edge group by src),
  up as (select id, parent as above from par union select up.id, par.parent from up join par on par.id = up.above),
  walk as (select n.id, cast(null as varchar) as parent, n.id as root, 0 as depth, n.id as path from n left join par using (id) where par.parent is null
           union all select par.id, par.parent, walk.root, walk.depth + 1, walk.path || ' > ' || par.id from walk join par on par.parent = walk.id),
  h as (select n.id as stmt_id, par.parent, walk.root, walk.depth, walk.path, case when exists (select 1 from up where up.id = n.id and up.above = n.id) then 'cycle' when walk.id is null then 'below_cycle' else 'tree' end as status
        from n left join par using (id) left join walk using (id))
"""


@query("p6_found", _EDGES + " reach as (select src as start, dst as node from edge union select r.start, e.dst from reach r join edge e on e.src = r.node) select start as stmt_id from reach where start = node")
def p6_found(spark, d):
    return H.cycle_members(read(spark, d, "trees")).withColumnRenamed("id", "stmt_id")


@query("p6_hierarchy", _UP + " select stmt_id, parent, root, depth, path, case when status <> 'cycle' then 1 + (select count(*) from up where up.above = h.stmt_id) end as subtree_size, status from h")
def p6_hierarchy(spark, d):
    return H.hierarchy(read(spark, d, "trees")).withColumnRenamed("id", "stmt_id").withColumn("path", F.array_join("path", " > "))


@query("p6_descendants", _UP + " select up.above as ancestor, up.id as descendant, a.depth - b.depth as distance from up join h a on a.stmt_id = up.id join h b on b.stmt_id = up.above where a.status = 'tree'")
def p6_descendants(spark, d):
    return H.descendants(H.hierarchy(read(spark, d, "trees")))


# Texts ------------------------------------------------------------------------------------------------

_CLEAN = r"trim(regexp_replace(regexp_replace(text, '\\label\{[^{}]+\}', '', 'g'), '[\s\x1c-\x1f\x{85}\p{Z}]+', ' ', 'g'))"


@query("clean_statements", "with " + STMT + rf"""
  c as (select stmt_id, {_CLEAN} as t, text, labels from s where text is not null)
  select stmt_id, length(t) as n_chars, md5(t) as clean_md5, cast(len(regexp_extract_all(text, '\\label\{{([^{{}}]+)\}}', 1)) as int) as n_labels,
         length(t) > 10 and length(t) < 3000 as in_range from c""")
def clean_statements(spark, d):
    s = statements(spark, d).where("text is not null")
    t = L.clean_text(F.col("text"))
    return s.select("stmt_id", F.length(t).cast("bigint").alias("n_chars"), F.md5(t).alias("clean_md5"), F.size(L.labels(F.col("text"))).alias("n_labels"), ((F.length(t) > 10) & (F.length(t) < 3000)).alias("in_range"))


@query("statement_kinds", "with " + STMT + """
  k as (select case when contains(lower(type_display), 'theorem') then 'Theorem' when contains(lower(type_display), 'lemma') then 'Lemma'
                    when contains(lower(type_display), 'proposition') then 'Proposition' when contains(lower(type_display), 'corollary') then 'Corollary'
                    when contains(lower(type_display), 'definition') then 'Definition' when contains(lower(type_display), 'claim') then 'Claim'
                    when contains(lower(type_display), 'conjecture') then 'Conjecture' end as kind from s)
  select kind, count(*) as n from k where kind is not null group by kind""")
def statement_kinds(spark, d):
    return statements(spark, d).select(L.kind_of(F.col("type_display")).alias("kind")).where("kind is not null").groupBy("kind").agg(F.count("*").alias("n"))


_FORMULA_FORMS = [r"(?s)\$\$.*?\$\$", r"(?s)\\\[.*?\\\]", *[rf"(?s)\\begin\{{{e}\*?\}}.*?\\end\{{{e}\*?\}}" for e in L.FORMULA_ENVIRONMENTS], r"(?s)\\\(.*?\\\)", r"\$[^$\\]*(?:\\(?s:.)[^$\\]*)*\$"]


def _formulas(c: str) -> tuple[str, str]:
    """SQL of the number of formulas in ``c``, and of ``c`` without them."""
    total, rest = [], c
    for p in _FORMULA_FORMS:
        total.append(f"len(regexp_extract_all({rest}, '{p}'))")
        rest = f"regexp_replace({rest}, '{p}', ' ', 'g')"
    return " + ".join(total), rest


def _words(c: str) -> str:
    """SQL of the number of content words in ``c``."""
    stop = ", ".join(f"'{w}'" for w in L.STOP_WORDS)
    rest = _formulas(rf"regexp_replace({c}, '\[(REF|TARGET)\]', ' ', 'g')")[1]
    return rf"len(list_filter(regexp_extract_all(regexp_replace({rest}, '\\[A-Za-z]+\*?', ' ', 'g'), '[A-Za-z]{{2,}}'), lambda w: not list_contains([{stop}], lower(w))))"


def _clean(c: str) -> str:
    return rf"trim(regexp_replace(regexp_replace({c}, '\\label\{{[^{{}}]+\}}', '', 'g'), '[\s\x1c-\x1f\x{{85}}\p{{Z}}]+', ' ', 'g'))"


def _balance(c: str) -> str:
    """SQL of whether environments nest rightly in ``c``."""
    kinds = rf"regexp_extract_all({c}, '\\(begin|end)\{{[^{{}}]+\}}', 1)"
    names = rf"regexp_extract_all({c}, '\\(?:begin|end)\{{([^{{}}]+)\}}', 1)"
    return f"""(select r.ok and len(r.st) = 0 from (select list_reduce(list_prepend(struct_pack(st := cast([] as varchar[]), ok := true, k := '', n := ''),
        list_transform(list_zip({kinds}, {names}), lambda z: struct_pack(st := cast([] as varchar[]), ok := true, k := z[1], n := regexp_replace(z[2], '\\*+$', '')))),
        lambda a, x: struct_pack(st := case when x.k = 'begin' then list_append(a.st, x.n) else a.st[:-2] end, ok := a.ok and (x.k = 'begin' or coalesce(a.st[-1] = x.n, false)), k := x.k, n := x.n)) as r))"""


_NF, _REST = _formulas("text")


@query("content_words", "with " + STMT + rf"""
  c as (select stmt_id, text from s where text is not null)
  select stmt_id, cast({_NF} as bigint) as n_formulas,
         cast(len(list_filter(regexp_extract_all(regexp_replace({_REST}, '\\[A-Za-z]+\*?', ' ', 'g'), '[A-Za-z]{{2,}}'),
              lambda w: not list_contains([{", ".join(f"'{w}'" for w in L.STOP_WORDS)}], lower(w)))) as bigint) as n_words from c""")
def content_words(spark, d):
    s = statements(spark, d).where("text is not null")
    return s.select("stmt_id", L.formula_count(F.col("text")).cast("bigint").alias("n_formulas"), L.content_words(F.col("text")).cast("bigint").alias("n_words"))


@query("environment_balance", "with " + STMT + r"""
  t as (select stmt_id, regexp_extract_all(text, '\\(begin|end)\{[^{}]+\}', 1) as k, list_transform(regexp_extract_all(text, '\\(?:begin|end)\{([^{}]+)\}', 1), lambda x: regexp_replace(x, '\*+$', '')) as n from s where text is not null),
  u as (select stmt_id, list_reduce(list_prepend(struct_pack(st := cast([] as varchar[]), ok := true, k := '', n := ''),
          list_transform(range(1, len(k) + 1), lambda i: struct_pack(st := cast([] as varchar[]), ok := true, k := k[i], n := n[i]))),
          lambda a, x: struct_pack(st := case when x.k = 'begin' then list_append(a.st, x.n) else a.st[:-2] end,
                                   ok := a.ok and (x.k = 'begin' or coalesce(a.st[-1] = x.n, false)), k := x.k, n := x.n)) as r from t)
  select balanced, count(*) as n from (select r.ok and len(r.st) = 0 as balanced from u) group by balanced""")
def environment_balance(spark, d):
    return statements(spark, d).where("text is not null").select(L.balanced(F.col("text")).alias("balanced")).groupBy("balanced").agg(F.count("*").alias("n"))


@query("identifiers", r"""
  with m as (select distinct id from paper_metadata union select distinct paper_id from proofs where paper_id is not null),
  t as (select id, regexp_replace(trim(id), 'v\d+$', '') as t from m where id is not null)
  select id, translate(id, './', '__') as file_id,
    case when regexp_full_match(t, '\d{4}_\d{4,5}') then replace(t, '_', '.')
         when regexp_full_match(t, '[a-z-]+_[A-Za-z]+_\d{7}') then regexp_replace(t, '^([a-z-]+)_([A-Za-z]+)_(\d{7})$', '\1.\2/\3')
         when regexp_full_match(t, '[a-z-]+_\d{7}') then regexp_replace(t, '^([a-z-]+)_(\d{7})$', '\1/\2') else t end as web_id from t""")
def identifiers(spark, d):
    m = read(spark, d, "paper_metadata").select("id").union(read(spark, d, "proofs").select("paper_id")).where("id is not null").distinct()
    return m.select("id", L.file_id(F.col("id")).alias("file_id"), L.web_id(F.col("id")).alias("web_id"))


# Attachment and references -----------------------------------------------------------------------------


@query("attached_proofs", "with " + STMT + PRF + """
  e as (select paper_id, char_end, max(stmt_id) as stmt_id from s where paper_id is not null and char_end is not null group by all)
  select p.proof_id, e.stmt_id as attached_stmt_id, p.char_start - e.char_end as attached_gap,
         case when len(coalesce(p.title_refs, [])) > 0 then 'explicit' when e.stmt_id is null then 'none' when p.char_start - e.char_end <= 1500 then 'high' else 'low' end as attach_confidence
  from p asof left join e on p.paper_id = e.paper_id and p.char_start >= e.char_end""")
def attached_proofs(spark, d):
    return A.attach_proofs(proofs(spark, d), statements(spark, d)).select("proof_id", "attached_stmt_id", "attached_gap", "attach_confidence")


@query("reference_resolution", "with " + STMT + PRF + r"""
  r as (select proof_id, paper_id, unnest(regexp_extract_all(text, '\\(?:c|C|auto|eq|name|labelc|v)?ref\*?\{([^{}]+)\}', 1)) as keys from p),
  one as (select proof_id, paper_id, trim(unnest(string_split(keys, ','))) as label from r),
  i as (select paper_id, label, max_by(stmt_id, struct_pack(c := char_start, i := stmt_id)) as target from (select paper_id, unnest(labels) as label, char_start, stmt_id from s where paper_id is not null) group by all)
  select one.proof_id, one.label, i.target, count(*) as n from one left join i using (paper_id, label) where one.label <> '' group by all""")
def reference_resolution(spark, d):
    refs = P.reference_spans(proofs(spark, d).select("proof_id", "paper_id", "text"))
    return refs.join(P.label_index(statements(spark, d)), ["paper_id", "label"], "left").groupBy("proof_id", "label", "target").agg(F.count("*").alias("n"))


_CITE = r"\\(?:c|C|auto|eq|name|labelc|v)?ref\*?\{([^{}]+)\}"
_IN_GLUE = ", ".join(f"'{w}'" for w in L.GLUE_WORDS)
_GLUE = rf"coalesce(length(GAP) <= 40 and len(list_filter(string_split(lower(trim(regexp_replace(GAP, '[\s,;&()\[\]{{}}~]+', ' ', 'g'))), ' '), lambda w: w <> '' and not list_contains([{_IN_GLUE}], w))) = 0, false)"
_QUOTED = {k: "(?i)" + getattr(L, k).replace("'", "''") for k in ("PROOF_OF_PATTERN", "DEFERRAL_PATTERN", "PROCEDURE_PATTERN", "CITATION_PATTERN")}
#: All references with their outcome; the same rules as plain steps of SQL.
_MINED = "with " + STMT + PRF + rf"""
  c as (select proof_id, paper_id, attached_stmt_id, text, regexp_extract_all(text, '{_CITE}', 0) as cites, regexp_extract_all(text, '{_CITE}', 1) as keys, string_split_regex(text, '{_CITE}') as gaps from p),
  n as (select *, unnest(range(1, len(cites) + 1)) as i from c),
  o as (select *, cast(list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(cites[1:i - 1], lambda x: length(x))), 0) as bigint) as start from n),
  lab as (select proof_id, paper_id, attached_stmt_id, text, i, start, gaps[i] as cgap, list_filter(list_transform(string_split(keys[i], ','), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') as labs from o),
  one as (select *, unnest(labs) as label, unnest(range(1, len(labs) + 1)) as j from lab),
  idx as (select paper_id, label, max_by(stmt_id, struct_pack(c := char_start, i := stmt_id)) as target from (select paper_id, unnest(labels) as label, char_start, stmt_id from s where paper_id is not null) group by all),
  r as (select one.*, idx.target, i * 1000 + j as ref_no, case when j = 1 then cgap else '' end as gap from one left join idx using (paper_id, label)),
  w as (select *, lag(target) over x as before, lead(target) over x as behind, lead(gap) over x as gap_behind, list_sort(list_distinct(list(target) over (partition by proof_id))) as invoked from r window x as (partition by proof_id order by ref_no)),
  e as (select *, case when target is null then 'unresolved' when coalesce(target = attached_stmt_id, false) then 'self'
        when (before is not null and before <> target and not coalesce(before = attached_stmt_id, false) and {_GLUE.replace("GAP", "gap")})
          or (behind is not null and behind <> target and not coalesce(behind = attached_stmt_id, false) and {_GLUE.replace("GAP", "gap_behind")}) then 'co_cited' end as early from w),
  q as (select *, case when early is null then {_clean(f"regexp_replace(regexp_replace(substr(text, 1, start) || '\\ref{{@@@}}', '{_QUOTED['CITATION_PATTERN'].replace('[^{}]*', '@@@')}', ' [TARGET] ', 'g'), '{_QUOTED['CITATION_PATTERN']}', ' [REF] ', 'g')")} end as query from e),
  m as (select *, length(query) - instr(reverse(query), ']TEGRAT[') - 6 as spot from q),
  m2 as (select *, case when instr(query, '[TARGET]') > 0 then substr(query, greatest(spot - 80, 1), spot + 48 - greatest(spot - 80, 1)) else substr(query, greatest(length(query) - 79, 1), 80) end as near,
         {_words("query")} as qw, {_formulas("query")[0]} as qf, len(regexp_extract_all(query, '\[(REF|TARGET)\]')) as qr from m),
  f as (select *, coalesce(early, case when length(query) < 80 then 'short' when qw < 30 and qf < 2 then 'thin_query' when qr >= 4 and qw < 4 then 'ref_heavy'
        when regexp_matches(near, '{_QUOTED["PROOF_OF_PATTERN"]}') then 'proof_ref' when regexp_matches(near, '{_QUOTED["DEFERRAL_PATTERN"]}') then 'deferral'
        when regexp_matches(near, '{_QUOTED["PROCEDURE_PATTERN"]}') and {_words(f"regexp_replace(query, '{_QUOTED['PROCEDURE_PATTERN']}', ' ', 'g')")} < 20 then 'procedural' end) as first_reason from m2),
  t as (select stmt_id as target, type as positive_type, {_clean("text")} as positive_text from s),
  t2 as (select *, coalesce(positive_text, '') as pt from t),
  t3 as (select *, case when length(pt) < 30 then 'short' when not {_balance("pt")} then 'malformed_pos' when {_words("pt")} < 20 and {_formulas("pt")[0]} < 1 then 'thin_pos'
         when len(regexp_extract_all(pt, '\\(?:c|C|auto|eq|name|labelc|v)?ref\*?\{{')) >= 2 and {_words("pt")} < 4 then 'ref_dep_pos' end as late from t2),
  g as (select f.*, positive_type, positive_text, coalesce(first_reason, late) as reason from f left join t3 using (target)),
  h as (select *, row_number() over (partition by query, target, reason is null order by proof_id, ref_no) as nth from g),
  mined as (select *, case when reason is null and nth > 1 then 'duplicate' else reason end as drop_reason from h)
"""


@query("reference_spans", _MINED.split("  r as (")[0].rstrip().rstrip(",") + """
  select proof_id, cast(i - 1 as bigint) * 1000 + j - 1 as ref_no, label, start, start + length(cites[i]) as stop from (select lab.*, c.cites, unnest(labs) as label, unnest(range(1, len(labs) + 1)) as j from lab join c using (proof_id))""")
def reference_spans(spark, d):
    r = P.reference_spans(proofs(spark, d).select("proof_id", "text"))
    return r.select("proof_id", F.col("ref_no").cast("long").alias("ref_no"), "label", F.col("start").cast("long").alias("start"), F.col("stop").cast("long").alias("stop"))


@query("mined_pairs", _MINED + """
  select paper_id || '::pair' || lpad(cast(row_number() over (order by proof_id, ref_no) - 1 as varchar), 7, '0') as pair_id, paper_id, query, target as positive_stmt_id, positive_type, positive_text,
         proof_id as source_proof_id, label as ref_label, array_to_string(invoked, ' ') as invoked_stmt_ids from mined where drop_reason is null""")
def mined_pairs(spark, d):
    m = P.mine_pairs(proofs(spark, d), statements(spark, d))
    return m.where("drop_reason is null").select("pair_id", "paper_id", "query", F.col("target").alias("positive_stmt_id"), "positive_type", "positive_text", F.col("proof_id").alias("source_proof_id"), F.col("label").alias("ref_label"), F.array_join("invoked_stmt_ids", " ").alias("invoked_stmt_ids"))


@query("mined_pairs_thought")
def mined_pairs_thought(spark, d):
    return P.mine_pairs(proofs(spark, d), statements(spark, d), "thought").where("drop_reason is null").select("pair_id", "query", "target")


@query("drop_report", _MINED + f"""
  , a as (select count(*) as "references", count(target) as resolved, cast(floor(100 * count(target) / count(*) + 0.5) as bigint) as resolved_percent, count(*) filter (where drop_reason is null) as emitted,
          count(distinct case when drop_reason is null then target end) as distinct_positives, count(*) filter (where drop_reason is null and trim(string_split(query, '[TARGET]')[-1]) <> '') as with_after_context,
          {", ".join(f"count(*) filter (where drop_reason = '{x}') as {x}" for x in P.REASONS)} from mined),
  b as (select count(*) as proofs, count(*) filter (where regexp_matches(text, '{_CITE}')) as proofs_with_reference from p)
  select * from (unpivot a on * into name counter value n) union all select * from (unpivot b on * into name counter value n)""")
def drop_report(spark, d):
    return P.drop_report(P.mine_pairs(proofs(spark, d), statements(spark, d)), proofs(spark, d))


# Negatives, filters, exports ----------------------------------------------------------------------------


_RING = "with " + STMT + PAIR + """
  d as (select distinct paper_id, stmt_id from s where paper_id is not null and stmt_id is not null),
  ring as (select paper_id, stmt_id, row_number() over (partition by paper_id order by md5(stmt_id), stmt_id) - 1 as spot, count(*) over (partition by paper_id) as size from d),
  ask as (select q.pair_id, q.paper_id, q.positive_stmt_id, list_distinct(list_filter(list_prepend(q.positive_stmt_id, coalesce(q.invoked_stmt_ids, [])), lambda x: x is not null)) as named,
               z.size, cast('0x' || substr(md5(q.pair_id), 1, 8) as bigint) % z.size as start from q join (select distinct paper_id, size from ring) z using (paper_id)),
  e as (select a.pair_id, a.positive_stmt_id, r.stmt_id, (r.spot - a.start + a.size) % a.size as k, a.size - (select count(*) from ring x where x.paper_id = a.paper_id and list_contains(a.named, x.stmt_id)) as num_eligible
        from ask as a join ring r on r.paper_id = a.paper_id and (r.spot - a.start + a.size) % a.size < 32 + len(a.named) where not list_contains(a.named, r.stmt_id)),
  chosen as (select * from (select *, row_number() over (partition by pair_id order by k) as r from e) where r <= 32),
""" + f"""
  sound as (select stmt_id, t from (select stmt_id, {_clean("text")} as t from s) where length(t) >= 25 and {_balance("t")}),
  neg as (select q.pair_id, q.paper_id, q.positive_stmt_id, coalesce(max(c.num_eligible), 0) as num_eligible, coalesce(list(sound.t order by c.r) filter (where sound.t is not null), []) as negatives
          from q left join chosen c using (pair_id) left join sound on sound.stmt_id = c.stmt_id group by all)
"""


@query("eligible_negatives", _RING + "select pair_id, stmt_id, cast(r as int) as rank, num_eligible from chosen")
def eligible_negatives(spark, d):
    return C.eligible_negatives(pairs(spark, d), statements(spark, d)).select("pair_id", "stmt_id", "rank", "num_eligible")


def _negatives(spark, d):
    return C.negatives(pairs(spark, d), statements(spark, d))


@query("negatives_report", _RING + """
  , a as (select count(*) as pairs, count(*) filter (where paper_id is null) as without_paper, count(*) filter (where positive_stmt_id is null) as without_positive, count(*) filter (where len(negatives) = 0) as without_negatives,
          count(*) filter (where num_eligible > 32) as capped, cast(sum(num_eligible) as bigint) as eligible, cast(sum(len(negatives)) as bigint) as negatives, cast(floor(1000 * sum(len(negatives)) / count(*)) as bigint) as mean_thousandths from neg),
  b as (select count(*) filter (where query is null) as missing_query, count(*) filter (where positive_text is null) as missing_positive_text, count(*) filter (where invoked_stmt_ids is null) as missing_invoked_stmt_ids from q)
  select * from (unpivot a on * into name counter value n) union all select * from (unpivot b on * into name counter value n)""")
def negatives_report(spark, d):
    return C.negatives_counters(pairs(spark, d), _negatives(spark, d))


@query("pairs_of_category", "with " + PAIR + r"""
  k as (select distinct translate(id, './', '__') as k from paper_metadata where list_contains(string_split_regex(trim(categories), '\s+'), 'math.AG'))
  select pair_id, paper_id from q where translate(paper_id, './', '__') in (select k from k)""")
def pairs_of_category(spark, d):
    return C.filter_by_category(pairs(spark, d), read(spark, d, "paper_metadata"), "math.AG").select("pair_id", "paper_id")


@query("pairs_of_prefix", "with " + PAIR + r"""
  k as (select distinct translate(id, './', '__') as k from paper_metadata where len(list_filter(string_split_regex(trim(categories), '\s+'), lambda x: starts_with(x, 'cs.'))) > 0)
  select pair_id, paper_id from q where translate(paper_id, './', '__') in (select k from k)""")
def pairs_of_prefix(spark, d):
    return C.filter_by_category(pairs(spark, d), read(spark, d, "paper_metadata"), "cs.", True).select("pair_id", "paper_id")


_TRAIN = _RING + r"""
  , tr as (select q.pair_id, regexp_replace(q.query, '^\s+|\s+$', '', 'g') as query, regexp_replace(q.positive_text, '^\s+|\s+$', '', 'g') as p, list_filter(list_transform(neg.negatives, lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') as negs from q join neg using (pair_id)),
  rec as (select pair_id, query, p, list_filter(negs, lambda x: x <> p) as neg from tr),
  outc as (select *, case when coalesce(length(query), 0) = 0 or coalesce(length(p), 0) = 0 then 'empty' when len(neg) < 4 then 'few_negatives' end as drop_reason from rec)
"""


@query("training_outcomes", _TRAIN + "select coalesce(drop_reason, 'kept') as outcome, count(*) as n, cast(sum(case when p is not null then len(neg) end) as bigint) as negatives from outc group by 1")
def training_outcomes(spark, d):
    r = C.training_records(pairs(spark, d), _negatives(spark, d))
    return r.groupBy(F.coalesce("drop_reason", F.lit("kept")).alias("outcome")).agg(F.count("*").alias("n"), F.sum(F.when(F.get("pos", F.lit(0)).isNotNull(), F.size("neg"))).alias("negatives"))


@query("training_sample", _TRAIN + """
  select pair_id, query, p as pos, md5(array_to_string(neg, '|')) as neg_md5, 'Given a proof so far, find the statement it uses.' as prompt from outc where drop_reason is null order by md5('42:' || pair_id), pair_id limit 500""")
def training_sample(spark, d):
    r = C.sampled_records(C.training_records(pairs(spark, d), _negatives(spark, d), prompt="Given a proof so far, find the statement it uses."), 500)
    return r.select("pair_id", "query", F.get("pos", F.lit(0)).alias("pos"), F.md5(F.array_join("neg", "|")).alias("neg_md5"), "prompt")


def _held_out(spark, d):
    s = read(spark, d, "pair_splits").groupBy("pair_id").agg(F.min("split").alias("split"))
    both = pairs(spark, d).join(s, "pair_id")
    return both.where("split = 'test'"), both.where("split = 'train'")


_HELD = "with " + PAIR + r"""
  b as (select q.*, s.split from q join (select pair_id, min(split) as split from pair_splits group by pair_id) s using (pair_id)),
  h as (select distinct sha1(regexp_replace(query, '^\s+|\s+$', '', 'g')) as h from b where split = 'train' and query is not null),
  ev as (select * from b where split = 'test' and query is not null and sha1(regexp_replace(query, '^\s+|\s+$', '', 'g')) not in (select h from h) order by pair_id limit 10000)
"""


@query("evaluation_queries", _HELD + "select pair_id, substr(pair_id, instr(pair_id, 'pair') + 4) as qid, md5(query) as query_md5 from ev")
def evaluation_queries(spark, d):
    test, train = _held_out(spark, d)
    return C.evaluation_queries(test, train).select("pair_id", L.query_id(F.col("pair_id")).alias("qid"), F.md5("query").alias("query_md5"))


_EVAL = _RING + r"""
  , b as (select q.*, z.split from q join (select pair_id, min(split) as split from pair_splits group by pair_id) z using (pair_id)),
  hs as (select distinct sha1(regexp_replace(query, '^\s+|\s+$', '', 'g')) as h from b where split = 'train' and query is not null),
  ev as (select * from b where split = 'test' and query is not null and sha1(regexp_replace(query, '^\s+|\s+$', '', 'g')) not in (select h from hs) order by pair_id limit 10000),
  picked as (select c.pair_id, c.stmt_id, c.r, sound.t from chosen c join sound using (stmt_id)),
  docs as (select positive_stmt_id as stmt_id, 0 as side, pair_id, 0 as at_no, positive_text as t from ev union all select p.stmt_id, 1, p.pair_id, p.r, p.t from picked p join ev using (pair_id)),
  first as (select distinct on (stmt_id) * from docs where stmt_id is not null order by stmt_id, side, pair_id, at_no)
"""


@query("evaluation_corpus", _EVAL + "select cast(row_number() over (order by side, pair_id, at_no) - 1 as varchar) as docid, md5(t) as text_md5 from first")
def evaluation_corpus(spark, d):
    test, train = _held_out(spark, d)
    ev = C.evaluation_queries(test, train)
    _, corpus, _ = C.evaluation_set(ev, C.negatives(ev, statements(spark, d)))
    return corpus.select(F.col("id").alias("docid"), F.md5("text").alias("text_md5"))


@query("evaluation_counters", _HELD + r"""
  , t as (select * from b where split = 'test'), l as (select count(*) filter (where query is not null and sha1(regexp_replace(query, '^\s+|\s+$', '', 'g')) in (select h from h)) as leaked, count(*) as candidates, count(*) filter (where query is null) as without_query from t),
  k as (select candidates, without_query, leaked, least(candidates - without_query - leaked, 10000) as kept, 10000 - least(candidates - without_query - leaked, 10000) as shortfall, cast(leaked = 0 as bigint) as no_overlap from l)
  select * from (unpivot k on * into name counter value n)""")
def evaluation_counters(spark, d):
    return C.evaluation_counters(*_held_out(spark, d))


@query("training_hashes", "with " + PAIR + r"""
  f as (select z.source as file, sha1(regexp_replace(q.query, '^\s+|\s+$', '', 'g')) as h from q join (select pair_id, min(source) as source from pair_splits group by pair_id) z using (pair_id)),
  n as (select file, count(*) as new_hashes from (select h, min(file) as file from f where h is not null group by h) group by file)
  select f.file, count(*) as queries, count(distinct h) as distinct_hashes, coalesce(max(n.new_hashes), 0) as new_hashes from f left join n using (file) group by f.file""")
def training_hashes(spark, d):
    src = read(spark, d, "pair_splits").groupBy("pair_id").agg(F.min("source").alias("file"))
    return C.training_hashes(pairs(spark, d).join(src, "pair_id").where("file is not null"))


@query("first_negatives", "with " + STMT + PAIR + """
  d as (select paper_id, stmt_id, coalesce(min(char_start), 0) as at_no from s where paper_id is not null and stmt_id is not null group by all),
  e as (select q.pair_id, d.stmt_id, row_number() over (partition by q.pair_id order by at_no, d.stmt_id) as r from q join d using (paper_id) where not list_contains(list_prepend(q.positive_stmt_id, coalesce(q.invoked_stmt_ids, [])), d.stmt_id))
  select pair_id, stmt_id, cast(r as int) as rank from e where r <= 32""")
def first_negatives(spark, d):
    return C.first_negatives(pairs(spark, d), statements(spark, d))


_WHITE = ["math.AG", "math.NT", "math.CO"]


@query("point_categories", "with " + r"""
  m as (select translate(id, './', '__') as k, min(trim(regexp_replace(categories, '\s+', ' ', 'g'))) as categories from paper_metadata where categories is not null group by 1),
  p as (select distinct doc_id, paper_id from documents), j as (select p.doc_id, p.paper_id, m.categories, nullif(string_split(m.categories, ' ')[1], '') as first from p left join m on m.k = translate(p.paper_id, './', '__'))
  select doc_id, first as "primary", coalesce(first in ('math.AG', 'math.NT', 'math.CO'), false) as primary_listed, coalesce(list_has_any(string_split(categories, ' '), ['math.AG', 'math.NT', 'math.CO']), false) as any_listed,
         coalesce(starts_with(categories, 'math.'), false) as shown from j""")
def point_categories(spark, d):
    rows = C.with_categories(read(spark, d, "documents").select("doc_id", "paper_id").distinct(), read(spark, d, "paper_metadata"))
    shown = C.shown_points(rows).select("doc_id", F.lit(True).alias("shown")).distinct()
    c = F.col("categories")
    return rows.select("doc_id", "primary", C.whitelisted(c, _WHITE).alias("primary_listed"), C.whitelisted(c, _WHITE, False).alias("any_listed")).join(shown, "doc_id", "left").fillna(False, ["shown"])


@query("category_papers", "with " + PAIR + r"""
  k as (select distinct translate(id, './', '__') as k from paper_metadata where list_contains(string_split_regex(trim(categories), '\s+'), 'math.AG'))
  select count(*) as pairs, count(distinct paper_id) as papers from q where translate(paper_id, './', '__') in (select k from k)""")
def category_papers(spark, d):
    kept = C.filter_by_category(pairs(spark, d), read(spark, d, "paper_metadata"), "math.AG")
    return kept.agg(F.count("*").alias("pairs"), F.count_distinct("paper_id").alias("papers"))


@query("evaluation_audit", "with " + PAIR + """
  qs as (select substr(pair_id, instr(pair_id, 'pair') + 4) as id from q where query is not null),
  d as (select distinct stmt_id as id from statements where text is not null),
  r as (select substr(pair_id, instr(pair_id, 'pair') + 4) as qid, positive_stmt_id as docid, 1 as relevance from q)
  select 'queries' as "check", count(*) as n from qs union all select 'corpus', count(*) from d union all select 'qrels', count(*) from r
  union all select 'duplicate_queries', count(*) from (select id from qs group by id having count(*) > 1) union all select 'duplicate_corpus', count(*) from (select id from d group by id having count(*) > 1)
  union all select 'duplicate_qrels', count(*) from (select qid, docid from r group by all having count(*) > 1)
  union all select 'queries_without_qrel', count(*) from (select id from qs except select qid from r) union all select 'orphan_qrels', count(*) from (select qid from r except select id from qs)
  union all select 'missing_documents', count(*) from (select docid from r except select id from d) union all select 'judged_queries', count(*) from (select id from qs intersect select qid from r)
  union all select 'relevance_' || relevance, count(*) from r group by relevance""")
def evaluation_audit(spark, d):
    q = pairs(spark, d)
    qid = L.query_id(F.col("pair_id"))
    return C.audit(
        q.where("query is not null").select(qid.alias("id")), statements(spark, d).where("text is not null").select(F.col("stmt_id").alias("id")), q.select(qid.alias("qid"), F.col("positive_stmt_id").alias("docid"), F.lit(1).alias("relevance"))
    )


# Graph, routing, vectors ---------------------------------------------------------------------------------


@query("dependency_closure", r"""
  with recursive n as (select distinct stmt_id as id from trees where stmt_id is not null),
  raw as (select distinct stmt_id as src, regexp_replace(e, '^\s+|\s+$', '', 'g') as e from (select stmt_id, unnest(depends_on) as e from trees) where e is not null),
  edge as (select distinct src, coalesce(a.id, b.id) as dst from raw left join n a on a.id = raw.e left join n b on b.id = split_part(raw.src, '::', 1) || '::' || raw.e where raw.e <> '' and coalesce(a.id, b.id) is not null),
  reach as (select src as start, dst as node from edge union select r.start, e.dst from reach r join edge e on e.src = r.node)
  select start, node from reach where start <> node""")
def dependency_closure(spark, d):
    _, edges = H.resolve_entries(read(spark, d, "trees"))
    return G.closure(edges).select("start", "node")


@query("dependency_texts", _EDGES + STMT.replace("s as", "s0 as").rstrip().rstrip(",") + r""",
  reach as (select src as start, dst as node, 1 as depth from edge where src <> dst union select r.start, e.dst, r.depth + 1 from reach r join edge e on e.src = r.node where e.dst <> r.start and r.depth < 60),
  near as (select start, node, min(depth) as depth from reach where contains(start, '::s') group by all)
  select start, near.node as stmt_id, depth, cast(row_number() over (partition by start order by depth, node) - 1 as int) as ordinal, md5(text) as text_md5 from near join s0 on s0.stmt_id = near.node where text is not null""")
def dependency_texts(spark, d):
    _, edges = H.resolve_entries(read(spark, d, "trees"))
    out = G.dependency_texts(edges, statements(spark, d))
    return out.select("start", "stmt_id", "depth", "ordinal", F.md5("text").alias("text_md5"))


@query("routing_shares", """
  with c as (select distinct category from sample_targets), r as (select distinct on (qid) * from routing where category is not null and qid is not null order by qid, category)
  select c.category, count(r.qid) as n, round(100.0 * count(r.qid) / (select count(*) from r), 4) as percent from c left join r using (category) group by c.category""")
def routing_shares(spark, d):
    r = read(spark, d, "routing").where("category is not null and qid is not null").groupBy("qid").agg(F.min("category").alias("category"))
    return R.routing_shares(r, read(spark, d, "sample_targets"))


@query("routing_argmax", """
  with r as (select qid, min(category) as category, any_value(probs) as probs from routing where probs is not null and qid is not null group by qid),
  e as (select qid, unnest(map_entries(probs)) as e from r), b as (select qid, e.key as best, row_number() over (partition by qid order by e.value desc, e.key) as k from e)
  select b.best as best, count(*) as n, count(*) filter (where r.category = b.best) as agree from b join r using (qid) where k = 1 group by 1""")
def routing_argmax(spark, d):
    r = read(spark, d, "routing").where("probs is not null and qid is not null").groupBy("qid").agg(F.min("category").alias("category"), F.any_value("probs").alias("probs"))
    r = r.where(F.size("probs") > 0).select("category", R.best_class(F.col("probs")).alias("best"))
    return r.groupBy("best").agg(F.count("*").alias("n"), F.count_if(F.col("category") == F.col("best")).alias("agree"))


_TOP = """with v as (select vec_id, cast(embedding as double[]) as e, label from embeddings),
  s as (select a.vec_id as qid, b.vec_id as docid, round(list_cosine_similarity(a.e, b.e), 6) as score from v a join v b on a.vec_id % 100 = 0 and a.vec_id <> b.vec_id),
  r as (select *, row_number() over (partition by qid order by score desc, docid) as rank from s)"""


def _run(spark, d, k):
    v = read(spark, d, "embeddings")
    return R.top_k(v, v.where("vec_id % 100 = 0"), k)


@query("nearest_vectors", _TOP + " select qid, docid, score, cast(rank as int) as rank from r where rank <= 20")
def nearest_vectors(spark, d):
    return _run(spark, d, 20)


@query("retrieval_metrics", _TOP + """,
  rel as (select a.vec_id as qid, b.vec_id as docid from v a join v b on a.vec_id % 100 = 0 and a.label = b.label and a.vec_id <> b.vec_id),
  n as (select qid, count(*) as n from rel group by qid),
  i as (select qid, n, (select sum(1 / log2(x + 1)) from range(1, least(n, 10) + 1) t(x)) as best from n),
  h as (select rel.qid, sum(case when rank <= 10 then 1 / log2(rank + 1) end) as dcg, count(*) filter (where rank <= 100) as found from rel join r using (qid, docid) group by rel.qid)
  select i.qid, round(coalesce(dcg, 0) / best, 6) as ndcg, round(coalesce(found, 0) / n, 6) as recall from i left join h using (qid)""")
def retrieval_metrics(spark, d):
    v = read(spark, d, "embeddings")
    q = v.where("vec_id % 100 = 0").select(F.col("vec_id").alias("qid"), "label")
    rel = q.join(v.select(F.col("vec_id").alias("docid"), "label"), "label").where("qid <> docid").select("qid", "docid", F.lit(1).alias("relevance"))
    return R.metrics(_run(spark, d, 100), rel)


@query("retrieval_means", "with per as (" + _SQL["retrieval_metrics"] + ") select count(*) as judged, round(avg(ndcg), 6) as ndcg, round(avg(recall), 6) as recall from per")
def retrieval_means(spark, d):
    return R.mean_metrics(retrieval_metrics(spark, d))


@query("reranked", _TOP + """,
  f as (select r.qid, r.docid, r.rank as before, round(-list_sum(list_transform(list_zip(a.e, b.e), lambda z: abs(z[1] - z[2]))), 6) as score from r join v a on a.vec_id = r.qid join v b on b.vec_id = r.docid where r.rank <= 50)
  select qid, docid, score, cast(row_number() over (partition by qid order by score desc, before) as int) as rank from f""")
def reranked(spark, d):
    v = read(spark, d, "embeddings").select("vec_id", "embedding")
    run = _run(spark, d, 50)
    both = run.join(v.select(F.col("vec_id").alias("qid"), F.col("embedding").alias("a")), "qid").join(v.select(F.col("vec_id").alias("docid"), F.col("embedding").alias("b")), "docid")
    dist = F.aggregate(F.zip_with("a", "b", lambda x, y: F.abs(x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)
    return R.rerank(run, both.select("qid", "docid", F.round(-dist, 6).alias("score")), 50)


_ROUTED = """with v as (select vec_id, cast(embedding as double[]) as e, cast(label as varchar) as label from embeddings),
  at_dim as (select label, i, avg(e[i]) as x from (select label, e, unnest(range(1, len(e) + 1)) as i from v where label is not null) group by all),
  mean as (select label, list(x order by i) as c from at_dim group by label),
  sim as (select vec_id, e, mean.label, round(list_cosine_similarity(e, c), 6) as s from v join mean on vec_id % 100 = 0),
  route as (select vec_id, e, label from (select *, row_number() over (partition by vec_id order by s desc, label) as k from sim) where k = 1),
  s as (select a.vec_id as qid, b.vec_id as docid, a.label as category, round(list_cosine_similarity(a.e, b.e), 6) as score from route a join v b on a.label = b.label and a.vec_id <> b.vec_id),
  r as (select *, row_number() over (partition by qid order by score desc, docid) as rank from s)"""


def _routed(spark, d, k):
    v = read(spark, d, "embeddings")
    asked = R.nearest_centroid(v.where("vec_id % 100 = 0"), v, "label")
    return asked, R.routed_search(v.withColumn("label", F.col("label").cast("string")), asked, k, "label")


@query("routed_search", _ROUTED + " select qid, docid, score, cast(rank as int) as rank from r where rank <= 20")
def routed_search(spark, d):
    return _routed(spark, d, 20)[1]


@query("routed_metrics", _ROUTED + """,
  rel as (select a.vec_id as qid, b.vec_id as docid from v a join v b on a.vec_id % 100 = 0 and a.label = b.label and a.vec_id <> b.vec_id),
  n as (select qid, count(*) as n from rel group by qid), i as (select qid, n, (select sum(1 / log2(x + 1)) from range(1, least(n, 10) + 1) t(x)) as best from n),
  h as (select rel.qid, sum(case when rank <= 10 then 1 / log2(rank + 1) end) as dcg, count(*) filter (where rank <= 100) as found from rel join r using (qid, docid) group by rel.qid),
  per as (select i.qid, round(coalesce(dcg, 0) / best, 6) as ndcg, round(coalesce(found, 0) / n, 6) as recall from i left join h using (qid)),
  acc as (select count(*) as n, round(avg(cast(route.label = v.label as int)), 6) as accuracy from route join v using (vec_id))
  select count(*) as judged, round(avg(ndcg), 6) as ndcg, round(avg(recall), 6) as recall, max(acc.accuracy) as accuracy, (select count(*) from (select qid from rel except select qid from r)) as missing from per, acc""")
def routed_metrics(spark, d):
    v = read(spark, d, "embeddings")
    asked, run = _routed(spark, d, 100)
    q = v.where("vec_id % 100 = 0").select(F.col("vec_id").alias("qid"), "label")
    rel = q.join(v.select(F.col("vec_id").alias("docid"), "label"), "label").where("qid <> docid").select("qid", "docid", F.lit(1).alias("relevance"))
    acc = R.accuracy(asked.withColumn("label", F.col("label").cast("string")), "category", "label").select("accuracy")
    return R.mean_metrics(R.metrics(run, rel)).crossJoin(acc).crossJoin(R.missing_queries(run, rel).agg(F.count("*").alias("missing")))


@query("unit_vectors", """
  select vec_id, round(sqrt(list_sum(list_transform(cast(embedding as double[]), lambda x: x * x))), 6) as norm, 1.0 as unit from embeddings""")
def unit_vectors(spark, d):
    sq = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return read(spark, d, "embeddings").select("vec_id", F.round(sq(F.col("embedding")), 6).alias("norm"), F.round(sq(R.l2_normalise(F.col("embedding"))), 6).alias("unit"))


@query("projection")
def projection(spark, d):
    return R.project(read(spark, d, "embeddings"))


# Exploration ------------------------------------------------------------------------------------------------


def points(spark, d):
    return read(spark, d, "documents").select("doc_id", F.col("source").alias("categories"), F.col("kind").alias("type"), "paper_id", "text", "n_chars")


@query("facet_counts", """
  select source as categories, case when grouping(kind) = 1 then 'All' else kind end as type, count(*) as n from documents where source is not null and kind is not null
  group by grouping sets ((source), (source, kind))""")
def facet_counts(spark, d):
    return X.facet_counts(points(spark, d), "categories", "type")


@query("facet_keyword", "select doc_id from documents where source in ('wiki_dump', 'bulk_tex') and kind = 'notes' and contains(lower(text), lower('Theorem 1'))")
def facet_keyword(spark, d):
    return X.keyword_filter(X.facet_filter(points(spark, d), ["wiki_dump", "bulk_tex"], "notes"), "Theorem 1").select("doc_id")


@query("keyword_capped", "with k as (select doc_id from documents where contains(lower(text), 'sheaf')) select doc_id from k where (select count(*) from k) <= 50000")
def keyword_capped(spark, d):
    return X.highlight(X.keyword_filter(points(spark, d), "SHEAF")).select("doc_id")


@query("paper_keyword", "select doc_id from documents where paper_id in ('4501_00007', '7802_10017') and contains(lower(text), 'measure')")
def paper_keyword(spark, d):
    return X.keyword_filter(X.paper_filter(points(spark, d), ["4501_00007", "7802_10017", "4501_00007"]), "measure").select("doc_id")


@query("keyword_in_order", """
  select doc_id, row_number() over (order by case source when 'wiki_dump' then 0 else 1 end, doc_id) - 1 as ordinal from (select distinct doc_id, source, text from documents) where source in ('wiki_dump', 'bulk_tex') and contains(lower(text), 'measure')""")
def keyword_in_order(spark, d):
    p = points(spark, d).select("doc_id", "categories", "text").distinct()
    return X.keyword_in_order(p, "Measure", ["wiki_dump", "bulk_tex"], "doc_id").select("doc_id", "ordinal")


@query("axis_extent", "select cast(floor(min(n_chars) / 5.0) * 5 as double) as low, cast((floor(max(n_chars) / 5.0) + 1) * 5 as double) as high from documents")
def axis_extent(spark, d):
    return X.axis_extent(points(spark, d), "n_chars")


@query("nth_points", """
  with n as (select doc_id, cast(row_number() over (order by doc_id) - 1 as int) as point_id, source from documents), k as (select *, row_number() over (partition by source order by point_id) - 1 as nth from n)
  select source as categories, point_id, doc_id from k where nth = 3""")
def nth_points(spark, d):
    return X.nth_of_facet(X.number_points(points(spark, d), ["doc_id"]), 3).select("categories", "point_id", "doc_id")


@query("recent_history", """
  with l as (select user_id, event_type, max(ts) as ts from events group by all), r as (select *, row_number() over (partition by user_id order by ts desc, event_type) as recency from l)
  select user_id, event_type, cast(recency as int) as recency from r where recency <= 20""")
def recent_history(spark, d):
    return X.recent_history(read(spark, d, "events"), ["event_type"], "ts", who="user_id").select("user_id", "event_type", "recency")


@query("category_options", """
  with c as (select distinct source as category from documents where source is not null)
  select category, cast(row_number() over (order by category) - 1 as int) as ordinal, category not in ('bulk_tex', 'wiki_dump', 'author_upload', 'journal_feed', 'seminar_scans') as disabled from c""")
def category_options(spark, d):
    return X.category_options(points(spark, d), ["bulk_tex", "wiki_dump", "author_upload", "journal_feed", "seminar_scans", "bulk_tex"])


# Set operations, last wins, first wins ---------------------------------------------------------------------


@query("first_texts", "select text_md5, doc_id from (select md5(text) as text_md5, doc_id, row_number() over (partition by md5(text) order by doc_id) as k from documents where text is not null) where k = 1")
def first_texts(spark, d):
    return read(spark, d, "documents").where("text is not null").groupBy(F.md5("text").alias("text_md5")).agg(F.min("doc_id").alias("doc_id"))


def records_of(papers: DataFrame) -> DataFrame:
    """Statements, proofs and proof sections that the extraction finds in papers (paper_id, text), one row each."""
    from lemmaworks.operators.spans import extract_papers

    s, p, c = extract_papers(papers)
    none = lambda k: F.lit(None).cast(k)
    out = s.select("paper_id", F.lit("statement").alias("part"), F.col("stmt_id").alias("id"), "env", "type", F.col("labels").alias("keys"), "text", "char_start", "char_end", F.lit(False).alias("truncated"), none("string").alias("attached_stmt_id"), none("int").alias("attached_gap"), none("string").alias("attach_confidence"))
    for part, t in (("proof", p), ("section", c)):
        out = out.unionByName(t.select("paper_id", F.lit(part).alias("part"), F.col("proof_id").alias("id"), F.lit(part).alias("env"), none("string").alias("type"), F.col("title_refs").alias("keys"), "text", "char_start", "char_end", "truncated", "attached_stmt_id", "attached_gap", "attach_confidence"))
    return out


@query("document_records")
def document_records(spark, d):
    return records_of(read(spark, d, "documents").select(F.col("doc_id").cast("string").alias("paper_id"), "text").distinct())


def rendered_papers(spark, d) -> DataFrame:
    """(paper_id, text): the papers that the rows of statements and proofs come from, put together in order of position."""
    at = ["paper_id", F.coalesce("char_start", F.lit(0)).alias("at")]
    # the stored label lists were cut out of the texts, which still hold them, or not: those that are missing are written
    lost = F.filter("labels", lambda x: ~F.contains("text", F.concat(F.lit("\\label{"), x, F.lit("}"))))
    shown = F.array_join(F.transform(F.coalesce(lost, F.array().cast("array<string>")), lambda x: F.concat(F.lit("\\label{"), x, F.lit("}"))), "")
    s = statements(spark, d).where("text is not null").select(*at, F.col("stmt_id").alias("id"), F.concat(F.lit("\\begin{"), "env", F.lit("}"), shown, F.lit("\n"), "text", F.lit("\n\\end{"), "env", F.lit("}")).alias("piece"), F.concat(F.lit("\\newtheorem{"), "env", F.lit("}{"), "type_display", F.lit("}\n")).alias("head"))
    p = proofs(spark, d).where("text is not null").select(*at, F.col("proof_id").alias("id"), F.concat(F.lit("\\begin{proof}"), F.coalesce(F.concat(F.lit("["), "title_arg", F.lit("]")), F.lit("")), F.lit("\n"), "text", F.lit("\n\\end{proof}")).alias("piece"), F.lit(None).cast("string").alias("head"))
    rows = s.unionByName(p).where("paper_id is not null")
    whole = rows.groupBy("paper_id").agg(F.array_join(F.array_sort(F.collect_set("head")), "").alias("head"), F.array_sort(F.collect_list(F.struct("at", "id", "piece"))).alias("pieces"))
    return whole.select("paper_id", F.concat("head", F.array_join(F.transform("pieces", lambda x: x["piece"]), "\n\n")).alias("text"))


@query("rendered_records")
def rendered_records(spark, d):
    return records_of(rendered_papers(spark, d))


@query("answered_texts", "select doc_id, text from (select distinct doc_id, text from documents) where text is not null")
def answered_texts(spark, d):
    t = read(spark, d, "documents").select("doc_id", "text").distinct().where("text is not null")
    answer = F.concat(F.lit("<think>[no]</think> noise "), F.to_json(F.array(F.struct("doc_id", "text"))), F.lit(" end"))
    j = F.get(L.json_array(answer, "array<struct<doc_id:bigint,text:string>>"), F.lit(0))
    return t.select(j["doc_id"].alias("doc_id"), j["text"].alias("text"))


@query("windowed_events", "select date_trunc('hour', ts) as start, event_type, count(*) as n, round(sum(value), 4) as total from events group by all")
def windowed_events(spark, d):
    from lemmaworks.streaming.incremental import windowed_events as w

    return w(read(spark, d, "events"))


@query("answer_blocks", r"""
  with t as (select distinct doc_id, text from documents where text is not null),
  b as (select doc_id, text, list_filter(list_transform(string_split(text, chr(10) || chr(10)), lambda x: regexp_replace(x, '^[\s\x0b\x1c-\x1f\x{85}\p{Z}]+|[\s\x0b\x1c-\x1f\x{85}\p{Z}]+$', '', 'g')), lambda x: x <> '') as parts from t)
  select doc_id, cast(len(list_distinct(parts)) as int) as blocks, md5(coalesce(parts[1], '')) as first_md5 from b""")
def answer_blocks(spark, d):
    t = read(spark, d, "documents").select("doc_id", "text").where("text is not null").distinct()
    answer = F.concat(F.lit("<think>not this<|sep|></think>"), F.replace(F.col("text"), F.lit("\n\n"), F.lit("<|sep|>")), F.lit("<|end|>"))
    blocks = t.select("doc_id", L.definition_blocks(answer).alias("b"))
    return blocks.select("doc_id", F.size("b").alias("blocks"), F.md5(F.coalesce(F.get("b", F.lit(0)), F.lit(""))).alias("first_md5"))


@query("rendered_counts", "with " + STMT + PRF + """
  r as (select paper_id, 'statement' as part, cast(len(coalesce(labels, [])) as bigint) as k from s where text is not null and paper_id is not null union all select paper_id, 'proof', cast(len(coalesce(title_refs, [])) as bigint) from p where text is not null and paper_id is not null)
  select paper_id, part, count(*) as n from r group by all""")
def rendered_counts(spark, d):
    return rendered_records(spark, d).where("part <> 'section'").groupBy("paper_id", "part").agg(F.count("*").alias("n"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_Q)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
