"""Bulk verification of case analogues on Spark: policy invariance, leak audit, uniqueness, clearance, release."""

from importlib import import_module

#: public names by module; a module is imported when one of its names is first used, so that workers load only what they run
_PUBLIC = {
    "functions.text": "STOPWORDS SubstitutionConflict contains_run fold substitute tokenize",
    "operators.cases": "CONTEXTUAL DECISION IDENTIFYING CaseSchema as_cases with_digest with_keyed_digest",
    "operators.gate": "back_map_by_case clear new_records refusals release shareable sign_off signoff_status",
    "operators.invariance": "check_invariance invariance_report python_equivalence python_policy sensitivity_probe sensitivity_report",
    "operators.leaks": "HIGH LOW MEDIUM find_leaks leak_report",
    "operators.proposals": "LocalModelTransformer ReplyError parse_replies",
    "operators.swaps": "RuleBasedTransformer Transformer mapping_conflicts",
    "operators.uniqueness": "count_matches count_shared estimate_uniqueness uniqueness_report",
    "plans.audit": "audit_leaks verify",
}
_MODULE_OF = {name: module for module, names in _PUBLIC.items() for name in names.split()}
__all__ = sorted(_MODULE_OF)


def __getattr__(name: str):
    if name not in _MODULE_OF:
        raise AttributeError(name)
    return getattr(import_module(f"{__name__}.{_MODULE_OF[name]}"), name)
