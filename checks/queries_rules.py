"""Registered queries: the superseded rule sets and the moves between rule sets."""

from __future__ import annotations

from checks import crm_views as crm
from checks.oracle_crm import as_text, with_parts
from checks.oracle_rules import VARIANTS
from checks.registration import register, texts
from leadsieve.operators import rules as r
from leadsieve.plans import queue as plan

CLOCK = crm.CLOCK
# output name -> name in the comparison rows
OTHER_NAMES = {
    "crm_touch_at": "crm_updated_at",
    "category_rank": "lrm_category_rank",
    "rep_id": "lrm_id",
    "rep_name": "lrm_name",
    "rep_email": "lrm_email",
}


def output_columns(rules: r.RuleSet) -> list[str]:
    renamed = dict(rules.renamed)
    return [renamed.get(c, c) for c in rules.columns]


def register_rule_set(rules: r.RuleSet) -> None:
    names = output_columns(rules)
    source = ", ".join(f"{OTHER_NAMES[c]} AS {c}" if c in OTHER_NAMES else c for c in names)
    times = tuple(c for c in names if c.endswith(("_at", "_at_audit", "_date", "_raw")) and c not in ("audit_date", "reschedule_time_raw"))
    sql = f"SELECT {as_text(names, times)} FROM (SELECT {source} FROM queue_row)"

    @register("rules_" + rules.name.replace(".", "_"), sql, parts=VARIANTS[rules.name])
    def run(spark, sf_dir):
        return texts(plan.build_queue(crm.crm_tables(spark, sf_dir), CLOCK, rules))


for _rules in r.RULE_SETS.values():
    if _rules is not r.CURRENT:
        register_rule_set(_rules)


@register(
    "rank_v1",
    "SELECT lead_id, category, rank_key, lrm_category_rank AS category_rank FROM ranked_row",
    parts=VARIANTS["v1"],
)
def rank_v1(spark, sf_dir):
    rows = plan.all_ranks(plan.flagged_leads(crm.crm_tables(spark, sf_dir), CLOCK, r.V1), r.V1)
    return rows.select("lead_id", "category", "rank_key", rows[plan.RANK].alias("category_rank"))


@register(
    "rank_v2",
    "SELECT lead_id, lrm_id, category, rank_key, lrm_category_rank FROM ranked_row WHERE lrm_category_rank <= 20",
    parts=VARIANTS["v2"],
)
def rank_v2(spark, sf_dir):
    rows = plan.ranked(plan.flagged_leads(crm.crm_tables(spark, sf_dir), CLOCK, r.V2), r.V2)
    return rows.select("lead_id", "lrm_id", "category", "rank_key", plan.RANK)


def migration_sql() -> str:
    """Both rule sets over the same data; each keeps its own copies of the fragments."""

    def own(name: str) -> str:
        return f"({with_parts('SELECT lead_id, category FROM flagged_row', VARIANTS[name])})"

    return f"""SELECT coalesce(o.category, '(none)') AS old_category, coalesce(n.category, '(none)') AS new_category,
      count(*) AS leads FROM {own('v6')} o FULL JOIN {own('v7.8')} n USING (lead_id) GROUP BY ALL"""


@register("rule_migration", migration_sql(), parts={})
def rule_migration(spark, sf_dir):
    return plan.rule_migration(crm.crm_tables(spark, sf_dir), CLOCK, r.V6, r.V7_8)
