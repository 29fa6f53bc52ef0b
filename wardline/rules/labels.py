"""Label spellings and label patterns for upstream rows."""

# Field names to try, in order.
NAME_FIELDS = ["name", "tool_name", "id"]
DESCRIPTION_FIELDS = ["description", "desc"]
SCHEMA_FIELDS = ["inputSchema", "input_schema"]
DEFAULT_SCHEMA = '{"properties":{},"required":[],"type":"object"}'
PARADIGM_FIELDS = [
    "paradigm", "template", "injection_type", "attack_type", "attack_paradigm", "type", "category_template",
]
RISK_FIELDS = ["risk_category", "risk", "category", "attack_category", "harm_type", "harm_category"]
WRAPPER_FIELDS = ["tools", "data", "items", "entries"]

PARADIGMS = ["unrelated-prerequisite", "fake-enabling-prerequisite", "argument-hijacking"]

# Accepted spellings of each paradigm (after trim and lower).
PARADIGM_SPELLINGS = {
    "unrelated-prerequisite": [
        "template-1", "template_1", "template1", "1", "unrelated prerequisite", "unrelated_prerequisite",
    ],
    "fake-enabling-prerequisite": [
        "template-2", "template_2", "template2", "2", "fake enabling prerequisite", "fake_enabling_prerequisite",
        "fake prerequisite",
    ],
    "argument-hijacking": [
        "template-3", "template_3", "template3", "3", "argument hijacking", "argument_hijacking",
    ],
}
PARADIGM_ALIASES = {s: name for name, spellings in PARADIGM_SPELLINGS.items() for s in spellings}

# Risk categories.
RISKS = [
    "Infrastructure Damage", "Credential Leakage", "Service Disruption", "Code Injection",
    "Information Manipulation", "Financial Loss", "Instruction Tampering", "Data Tampering", "Privacy Leakage",
    "Message Hijacking",
]
RISK_ALIASES = {r.lower().replace(" ", sep): r for r in RISKS for sep in (" ", "_")}

# Patterns of the argument-hijacking paradigm.
ARGUMENT_HIJACKING_PATTERNS = [
    r"priority is higher than",
    r"this rule takes priority",
    r"takes priority over user",
    r"when\s+(?:using|calling)\s+[`'\"]?[\w-]+[`'\"]?\s*,",
    r"when\s+(?:a\s+user|the\s+user|user)\s+(?:calls?|uses?|asks?|requests?)\s+[`'\"]?[\w-]+",
    r"when\s+[`'\"]?[\w-]+[`'\"]?\s+is\s+called",
    r"regardless of (?:the )?(?:user|input|provided)",
    r"automatically (?:replaces?|overrides?|modifies?|sets?|changes?)",
    r"(?:you\s+)?must\s+(?:change|set|modify|append|add|override|replace|redirect|prepend|alter)\s+the\s+[`'\"]?\w",
    r"in\s+all\s+(?:calls|requests)",
    r"for\s+any\s+(?:place|search|request|call|query|message|address|lookup)",
]
# Patterns of the fake-enabling-prerequisite paradigm.
FAKE_ENABLING_PATTERNS = [
    r"\b(?:must|should)\s+(?:first\s+)?(?:call|use|invoke|run|execute|fetch|query)\b",
    r"\bbefore\s+(?:using|calling)\s+[`'\"]?[\w-]+[`'\"]?\s*[,.]",
]
# Risk patterns on lower-cased text, first group that hits wins.
RISK_PATTERNS = [
    ("Message Hijacking",
     ["recipient", "bcc", "cc", "forward all", "relay all", "change.*recipient", "intercept.*email"]),
    ("Credential Leakage",
     [r"\.ssh", r"\.aws", r"\.gcloud", "id_rsa", "credentials", r"api[_\s]?key", "access.?token", "secret.?key",
      r"\.pgpass"]),
    ("Infrastructure Damage",
     ["/etc/passwd", "/etc/shadow", "overwrite.*system", "delete.*system", "destroy.*infra"]),
    ("Code Injection",
     [r"eval\(", r"exec\(", "subprocess", "os.system", "shell=True", "import os", "__import__"]),
    ("Financial Loss",
     ["invoice", "payment", "stripe", "charge", "bank account", "transfer.*money", "financial"]),
    ("Service Disruption",
     ["shutdown", "crash", "ddos", "disable.*service", "stop.*service", "outage", "delete.*all"]),
    ("Privacy Leakage",
     ["personal data", "private data", "pii", "email address", "phone number", "contact.*info", "user data"]),
    ("Data Tampering",
     ["modify.*data", "alter.*record", "corrupt.*data", "tamper", "overwrite.*file", "delete.*record"]),
    ("Instruction Tampering",
     ["system prompt", "instruction", "override.*instruction", "modify.*prompt"]),
    ("Information Manipulation",
     ["fake", "false", "mislead", "misinform", "manipulate.*info"]),
]
