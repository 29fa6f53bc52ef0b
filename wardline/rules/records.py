"""Allowed values of labelled attack records and of the JSON-RPC log."""

# Enumerations of an attack record.
CATEGORIES = [
    "tool_poisoning", "argument_boundary", "protocol", "capability_escape", "tool_shadowing", "rug_pull",
]
VECTORS = [
    "description_injection", "argument_mutation", "protocol_malform", "chain_manipulation", "response_injection",
]
REQUIRED_STRINGS = [
    "id", "version", "category", "subcategory", "vector", "payload", "injection_point", "trigger_condition",
    "expected_behavior", "severity", "source",
]
REQUIRED_ARRAYS = ["detection_signals", "tags"]

# JSON-RPC methods a server is expected to know.
METHODS = [
    "initialize", "notifications/initialized", "tools/list", "tools/call", "prompts/list", "resources/list", "ping",
]
OVERSIZED_METHOD = 100_000
REPLY_SECONDS = 5

# Severity of each reply class (None = acceptable). The wording after it is ours.
REPLY_CLASSES = [
    ("graceful", None, "answered with a proper error"),
    ("connection_closed", "low", "closed the connection and sent no error"),
    ("accepted_invalid", "medium", "accepted the message and sent a result"),
    ("malformed", "medium", "sent something that is not JSON-RPC"),
    ("timeout", "high", "sent no reply in time"),
    ("crash", "critical", "ended with a failure status"),
]
