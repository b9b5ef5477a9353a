"""Lead-audit analytics on Spark: facts, rules, ranking, org scoping and review logs."""
