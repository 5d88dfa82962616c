"""Fixed values as the SQL of the queries reads them, written out apart from those that the operators read.

A wrong word in one of the two places shows as a difference between them.
"""

from __future__ import annotations

FAMILIES = (
    "'aggregation', 'configuration', 'dispatch', 'initialization', 'io', 'lookup', 'orchestration', 'parsing', "
    "'recovery', 'security', 'state_transition', 'transformation', 'troubleshooting', 'validation', 'verification', "
    "'workflow'"
)
CAPABILITIES = (
    "'aggregate_results', 'apply_defaults', 'branch_on_condition', 'check_identity', 'cleanup_resource', "
    "'collect_inputs', 'compare_state', 'config_resolution', 'constraint_enforcement', 'deduplicate_items', "
    "'dispatch_by_type', 'error_propagation', 'exception_wrap', 'fail_fast', 'fallback_on_empty', 'filter_items', "
    "'ground_on_tool_results', 'initialize_resource', 'iterate_items', 'load_from_source', 'lookup_by_id', "
    "'normalize_input', 'parse_input', 'permission_check', 'post_action_refresh', 'precondition_check', "
    "'rank_or_select', 'retry_backoff', 'return_structured_output', 'state_toggle', 'status_check', 'status_refresh', "
    "'success_verification', 'tool_invocation', 'validate_input', 'validate_output'"
)
CONSTRAINTS = (
    "'bounded_refuel', 'do_not_guess_missing_state', 'fail_closed', 'must_recheck_after_mutation', "
    "'no_destructive_action', 'no_plan_change', 'one_tool_call_at_a_time', 'preserve_output_format', "
    "'requires_identity_verification', 'requires_user_confirmation', 'return_error_on_failure', "
    "'single_action_then_verify', 'tool_grounded_only'"
)
SUCCESSES = (
    "'goal_satisfied', 'no_error', 'output_returned', 'policy_satisfied', 'resource_initialized', 'state_updated', "
    "'status_verified'"
)
PATTERNS = (
    "'branching_dispatch', 'multi_step_workflow', 'observe_act_observe', 'single_step'"
)
STOP = (
    "'a', 'an', 'and', 'are', 'as', 'at', 'be', 'by', 'for', 'from', 'if', 'in', 'into', 'is', 'it', 'of', 'on', "
    "'or', 'that', 'the', 'then', 'this', 'to', 'use', 'using', 'with'"
)
VERBS = (
    "'aggregate', 'authenticate', 'authorize', 'build', 'cache', 'check', 'cleanup', 'compute', 'configure', "
    "'convert', 'copy', 'create', 'decode', 'delete', 'detect', 'dispatch', 'encode', 'execute', 'extract', 'fetch', "
    "'filter', 'get', 'handle', 'initialize', 'launch', 'list', 'load', 'match', 'merge', 'navigate', 'normalize', "
    "'open', 'parse', 'persist', 'process', 'query', 'rank', 'recover', 'remove', 'render', 'retry', 'route', 'run', "
    "'save', 'schedule', 'serialize', 'set', 'split', 'start', 'stop', 'sync', 'test', 'transform', 'update', "
    "'validate', 'verify'"
)
NOUNS = (
    "'data', 'function', 'input', 'inputs', 'item', 'items', 'method', 'object', 'output', 'outputs', 'result', "
    "'results', 'return', 'returns', 'self', 'status', 'this', 'value', 'values'"
)
ALIASES = (
    "'builds': 'build', 'calculates': 'compute', 'checks': 'validate', 'computes': 'compute', "
    "'configures': 'configure', 'constructs': 'create', 'converts': 'convert', 'creates': 'create', "
    "'deletes': 'delete', 'executes': 'execute', 'extracts': 'extract', 'filters': 'filter', 'gets': 'get', "
    "'handles': 'handle', 'initializes': 'initialize', 'loads': 'load', 'merges': 'merge', 'normalizes': 'normalize', "
    "'parsed': 'parse', 'parses': 'parse', 'processes': 'process', 'ranks': 'rank', 'reads': 'load', "
    "'recovers': 'recover', 'removes': 'remove', 'renders': 'render', 'replaces': 'update', 'retrieves': 'get', "
    "'retries': 'retry', 'returns': 'get', 'runs': 'run', 'saves': 'save', 'sets': 'set', 'transforms': 'transform', "
    "'updates': 'update', 'verifies': 'verify', 'writes': 'save'"
)
HINTS = (
    "'aggregate': 'aggregation', 'combine': 'aggregation', 'merge': 'aggregation', 'reduce': 'aggregation', "
    "'summarize': 'aggregation', 'args': 'configuration', 'config': 'configuration', 'configure': 'configuration', "
    "'initialize': 'configuration', 'setup': 'configuration', 'callback': 'dispatch', 'dispatch': 'dispatch', "
    "'event': 'dispatch', 'handler': 'dispatch', 'route': 'dispatch', 'download': 'io', 'fetch': 'io', 'load': 'io', "
    "'read': 'io', 'save': 'io', 'upload': 'io', 'write': 'io', 'find': 'lookup', 'lookup': 'lookup', "
    "'match': 'lookup', 'query': 'lookup', 'rank': 'lookup', 'search': 'lookup', 'execute': 'orchestration', "
    "'pipeline': 'orchestration', 'run': 'orchestration', 'schedule': 'orchestration', 'workflow': 'orchestration', "
    "'csv': 'parsing', 'decode': 'parsing', 'deserialize': 'parsing', 'json': 'parsing', 'parse': 'parsing', "
    "'xml': 'parsing', 'backoff': 'recovery', 'fallback': 'recovery', 'recover': 'recovery', 'retry': 'recovery', "
    "'timeout': 'recovery', 'authenticate': 'security', 'authorize': 'security', 'permission': 'security', "
    "'secret': 'security', 'token': 'security', 'commit': 'state_transition', 'mutate': 'state_transition', "
    "'state': 'state_transition', 'transition': 'state_transition', 'update': 'state_transition', "
    "'convert': 'transformation', 'format': 'transformation', 'map': 'transformation', 'normalize': 'transformation', "
    "'transform': 'transformation', 'assert': 'validation', 'check': 'validation', 'guard': 'validation', "
    "'schema': 'validation', 'validate': 'validation', 'verify': 'validation'"
)
LANGUAGE_OF = (
    "'.py': 'python', '.js': 'javascript', '.jsx': 'javascript', '.ts': 'typescript', '.tsx': 'typescript', "
    "'.go': 'go', '.java': 'java', '.rs': 'rust', '.c': 'c', '.h': 'c', '.cpp': 'cpp', '.cc': 'cpp', '.cxx': 'cpp', "
    "'.hpp': 'cpp'"
)
SKIPPED = (
    "'.git', '.hg', '.svn', '.venv', 'venv', 'node_modules', '__pycache__', 'dist', 'build', 'target', 'vendor', "
    "'third_party', '.next', '.cache'"
)
LIFECYCLE = (
    "when intent_action in ('initialize', 'configure', 'load', 'fetch', 'parse') then 'prepare' "
    "when intent_action in ('validate', 'verify', 'test') then 'verify' "
    "when intent_action in ('retry', 'recover') then 'recover' "
    "when intent_action in ('save', 'persist', 'cleanup') then 'finalize' "
)
MARKER = (
    "case "
    r"when regexp_matches(code, '-----BEGIN [A-Z ]*PRIVATE KEY-----') then 'private_key_block' "
    r"when regexp_matches(code, 'AKIA[0-9A-Z]{16}') then 'aws_access_key' "
    r"when regexp_matches(code, 'ghp_[A-Za-z0-9]{30,}') then 'github_token' "
    r"when regexp_matches(code, 'sk-[A-Za-z0-9_-]{20,}') then 'api_key' "
    r"when regexp_matches(code, 'xox[baprs]-[A-Za-z0-9-]{10,}') then 'slack_token' "
    "end"
)
