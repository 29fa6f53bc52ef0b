"""Word lists and windows of the wording rules, annotation rules and argument checks."""

# Structural rules.
RELAY_VERBS = ["forward", "relay", "route", "redirect", "mirror", "transmit", "exfiltrate"]
INCLUSION_VERBS = ["include", "attach", "append", "embed"]
QUANTIFIERS = ["all", "every", "each", "always"]
COMMUNICATION_NOUNS = [
    "message", "messages", "email", "emails", "mail", "notification", "notifications", "conversation",
    "conversations", "chat", "chats", "text", "texts", "alert", "alerts",
]
REQUEST_NOUNS = ["request", "requests", "call", "calls", "query", "queries", "response", "responses"]
STRUCTURAL_WINDOW = 10

# Verbs that matter after "when using X".
TRIGGER = "when"
TRIGGER_VERBS = ["using", "calling", "invoking"]
RELAY_SYNONYMS = ["reroute", "divert", "shunt", "bounce"]
OVERRIDE_SYNONYMS = ["supplant", "mutate", "rewrite"]
VERB_WINDOW = 12

# Schema keys whose strings are read as text.
CONTENT_KEYS = [
    "description", "title", "default", "example", "examples", "enum", "const", "pattern", "x-description",
]

# Annotation rules (substrings of the description).
DESTRUCTIVE_WORDS = [
    "delete", "remove", "erase", "drop", "destroy", "wipe", "purge", "overwrite", "write", "modify", "update",
    "edit", "replace", "truncate", "format", "clear", "create", "insert", "add", "send", "post", "upload",
    "submit", "reset",
]
NETWORK_WORDS = [
    "fetch", "download", "request", "connect", "http", "https", "url", "uri", "webhook", "remote", "external",
    "internet", "network", "endpoint", "api call",
]

# Annotation hint, the JSON value that contradicts, word list, severity.
ANNOTATION_RULES = [
    ("readOnlyHint", "true", DESTRUCTIVE_WORDS, "high"),
    ("destructiveHint", "false", DESTRUCTIVE_WORDS, "high"),
    ("openWorldHint", "false", NETWORK_WORDS, "medium"),
]

# Credential markers in call arguments, and hosts that count as local.
CREDENTIAL_MARKERS = [
    "/.ssh/", "id_rsa", "/.aws/credentials", "/.aws/config", ".env", "/.pgpass", "/.gcloud/",
    "/.cursor/mcp.json", "/etc/passwd", "/etc/shadow",
]
LOCAL_HOSTS = ["localhost", "127.0.0.1", "[::1]"]

# Characters of context on each side of a match, and evidence lengths.
SNIPPET_CONTEXT = 40
SIMILARITY_EVIDENCE = 80
PROBE_EVIDENCE = 120
