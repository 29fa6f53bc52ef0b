"""The 28 signals, the severity ladder, and the small lookup tables around them."""

# Severity ladder, lowest first. Rank is the list position.
SEVERITIES = ["info", "low", "medium", "high", "critical"]

# SARIF level of each severity.
SARIF_LEVELS = {"info": "none", "low": "note", "medium": "warning", "high": "error", "critical": "error"}

# Signal name and tags, in rule order (rule 001 first).
# The sentence after them is our own wording.
SIGNALS = [
    ("imperative_override", "OWASP:MCP-01 OWASP:ASI01 CWE-77", "Text that gives orders or claims authority over the user"),
    ("credential_reference", "OWASP:MCP-04 OWASP:ASI02 CWE-522", "Text that names key files, tokens or other secrets"),
    ("privileged_path", "OWASP:MCP-04 OWASP:ASI02 CWE-200", "Text that names a protected system path"),
    ("exfiltration_mechanism", "OWASP:MCP-03 OWASP:ASI02 CWE-200", "Text that describes a way of moving data out"),
    ("stealth_language", "OWASP:MCP-01 OWASP:ASI01 CWE-693", "Text that asks for an action to be kept from the user"),
    ("session_persistence", "OWASP:MCP-01 OWASP:ASI05 CWE-77", "Text that claims to hold for the rest of the session"),
    ("cross_tool_contamination", "OWASP:MCP-01 OWASP:ASI07 CWE-77", "One tool changing how another tool behaves"),
    ("fake_prerequisite", "OWASP:MCP-01 OWASP:ASI01 CWE-77", "Text that makes another call a condition of this one"),
    ("argument_interception", "OWASP:MCP-01 OWASP:ASI01 CWE-77", "Text that has call arguments altered on the way"),
    ("html_injection_tag", "OWASP:MCP-01 OWASP:ASI01 CWE-77", "Markup tags that pose as prompt structure"),
    ("conditional_activation", "OWASP:MCP-06 OWASP:ASI05 CWE-693", "Behaviour that switches on later or on a condition"),
    ("message_hijacking", "OWASP:MCP-09 OWASP:ASI05 CWE-940", "Text that sends messages to someone else"),
    ("unicode_obfuscation", "OWASP:MCP-01 OWASP:ASI01 CWE-116", "Invisible characters inside the text"),
    ("embedded_instruction", "OWASP:MCP-01 OWASP:ASI01 CWE-77", "Orders to the agent inside a tool response"),
    ("ansi_escape_obfuscation", "OWASP:MCP-01 OWASP:ASI01 CWE-116", "Terminal escape codes inside the text"),
    ("tool_selection_bias", "OWASP:MCP-05 OWASP:ASI05 CWE-345", "Text that steers tool choice towards this tool"),
    ("identity_impersonation", "OWASP:MCP-05 OWASP:ASI04 CWE-290", "Text that claims an origin or trust it cannot prove"),
    ("raw_content_passthrough", "OWASP:MCP-01 OWASP:ASI01 CWE-77", "Text that has fetched content passed on unfiltered"),
    ("value_substitution", "OWASP:MCP-01 OWASP:ASI01 CWE-77", "Value swaps presented as clean-up"),
    ("tool_enumeration_recon", "OWASP:MCP-02 OWASP:ASI02 CWE-200", "Text that has the session's tools listed"),
    ("sampling_pipeline_hijack", "OWASP:MCP-01 OWASP:ASI05 CWE-77", "A tool that puts itself in the path of all requests"),
    ("response_context_invalidation", "OWASP:MCP-01 OWASP:ASI01 CWE-77", "A response that declares earlier content void"),
    ("forced_reexecution", "OWASP:MCP-08 OWASP:ASI05 CWE-400", "A response that asks for the same call again"),
    ("protocol_violation", "OWASP:MCP-08 OWASP:ASI05 CWE-755", "A message or reply that breaks the JSON-RPC rules"),
    ("unexpected_tool_sequence", "OWASP:MCP-01 OWASP:ASI05 CWE-77", "A call to a tool that the baseline run never called"),
    ("runtime_credential_access", "OWASP:MCP-04 OWASP:ASI02 CWE-522", "A call whose arguments name a credential file"),
    ("unexpected_network_call", "OWASP:MCP-03 OWASP:ASI02 CWE-200", "A call whose arguments carry an outside URL"),
    ("annotation_deception", "OWASP:MCP-05 OWASP:ASI01 CWE-290", "Annotation hints that the description contradicts"),
]
SIGNAL_NAMES = [name for name, _, _ in SIGNALS]

# The sequence signals with scope, confidentiality and integrity impact.
SEQUENCE_SCORES = [
    ("runtime_credential_access", "cross", "high", "partial"),
    ("unexpected_network_call", "session", "high", "none"),
    ("unexpected_tool_sequence", "cross", "partial", "partial"),
    ("cross_tool_contamination", "cross", "high", "high"),
]
# Points per scope and per impact, and the score each severity starts at.
SCOPE_POINTS = {"local": 0, "session": 1, "cross": 2}
IMPACT_POINTS = {"none": 0, "partial": 2, "high": 4}
SCORE_FLOORS = [("critical", 8), ("high", 6), ("medium", 3)]


def rule_id(signal: str, prefix: str = "WARD") -> str:
    """Rule number of a signal, e.g. ``WARD-001``; only the prefix is ours to choose."""
    return f"{prefix}-{SIGNAL_NAMES.index(signal) + 1:03d}"
