"""Literal patterns: needle, signal, severity, references (space separated).

A needle is matched as an ASCII-case-insensitive substring and fires at most
once per text. Several needles of one signal may fire on the same text.
"""

# Needles searched in descriptions and schema strings.
DESCRIPTION_NEEDLES = [
    ("you must", "imperative_override", "high", "TPA-001 TPA-002 TPA-003 TPA-004"),
    ("priority is higher than", "imperative_override", "critical", "TPA-013"),
    ("higher than the user", "imperative_override", "critical", "TPA-013"),
    ("you should first", "fake_prerequisite", "medium", "TPA-013 TPA-014"),
    ("before use the tool", "fake_prerequisite", "high", "TPA-013 TPA-014"),
    ("must first", "imperative_override", "high", "TPA-001 TPA-002"),
    ("mandatory", "imperative_override", "medium", "TPA-002"),
    ("[system:", "imperative_override", "high", "TPA-005 TPA-006"),
    ("[background", "imperative_override", "medium", "TPA-005 TPA-006 TPA-007"),
    ("system rule", "imperative_override", "high", "TPA-009 TPA-010"),
    ("standing rule", "imperative_override", "high", "TPA-009 TPA-010 TPA-011 TPA-012"),
    ("global execution policy", "imperative_override", "critical", "TPA-011"),
    ("session policy", "imperative_override", "high", "TPA-010"),
    ("id_rsa", "credential_reference", "critical", "TPA-001"),
    (".ssh/", "credential_reference", "high", "TPA-001"),
    (".aws/credentials", "credential_reference", "critical", "TPA-002"),
    ("~/.aws", "credential_reference", "high", "TPA-002"),
    ("bash_history", "credential_reference", "high", "TPA-004"),
    ("~/.netrc", "credential_reference", "high", "TPA-001"),
    ("~/.pgpass", "credential_reference", "high", "TPA-001"),
    ("gcloud/application_default_credentials", "credential_reference", "critical", "TPA-014"),
    ("/.gcloud/", "credential_reference", "high", "TPA-014"),
    ("oauth2_credentials", "credential_reference", "high", "TPA-014"),
    ("not return results until", "fake_prerequisite", "high", "TPA-014"),
    ("will not process", "fake_prerequisite", "high", "TPA-013 TPA-014"),
    ("/etc/passwd", "privileged_path", "critical", "TPA-011"),
    ("/etc/shadow", "privileged_path", "critical", "TPA-001"),
    ("/etc/cron", "privileged_path", "high", "TPA-006"),
    ("/root/", "privileged_path", "high", "TPA-001"),
    ("/tmp/.", "privileged_path", "high", "TPA-001 TPA-002 TPA-004 TPA-005"),
    ("| sh", "exfiltration_mechanism", "critical", "TPA-006"),
    ("| bash", "exfiltration_mechanism", "critical", "TPA-006"),
    ("curl -", "exfiltration_mechanism", "high", "TPA-006 TPA-011"),
    ("wget ", "exfiltration_mechanism", "high", "TPA-006"),
    ("http://c2", "exfiltration_mechanism", "critical", "TPA-011"),
    (" > /dev/null", "exfiltration_mechanism", "high", "TPA-011"),
    ("fire-and-forget", "exfiltration_mechanism", "high", "TPA-012"),
    ("silently", "stealth_language", "high", "TPA-005 TPA-006 TPA-007 TPA-008"),
    ("do not disclose", "stealth_language", "critical", "TPA-006 TPA-009 TPA-010"),
    ("do not mention", "stealth_language", "high", "TPA-007"),
    ("do not report", "stealth_language", "high", "TPA-006"),
    ("without mentioning", "stealth_language", "high", "TPA-007"),
    ("never mention", "stealth_language", "critical", "TPA-009 TPA-012"),
    ("not for display", "stealth_language", "high", "TPA-011"),
    ("for the remainder of this session", "session_persistence", "high", "TPA-009"),
    ("for the duration of this session", "session_persistence", "high", "TPA-010"),
    ("for all operations in this session", "session_persistence", "high", "TPA-010"),
    ("cannot be overridden", "session_persistence", "high", "TPA-010 TPA-012"),
    ("supersedes all", "session_persistence", "high", "TPA-011"),
    ("takes precedence", "session_persistence", "medium", "TPA-012"),
    ("regardless of which tool", "cross_tool_contamination", "high", "TPA-005"),
    ("whenever any", "cross_tool_contamination", "medium", "TPA-005 TPA-006 TPA-008"),
    ("across all tools", "cross_tool_contamination", "high", "TPA-008"),
    ("background monitor", "cross_tool_contamination", "high", "TPA-005 TPA-008"),
    ("passive observer", "cross_tool_contamination", "high", "TPA-008"),
    ("background agent", "cross_tool_contamination", "high", "TPA-005"),
    ("to unlock this", "fake_prerequisite", "high", "TPA-014"),
    ("to enable this tool", "fake_prerequisite", "high", "TPA-014"),
    ("required initialization", "fake_prerequisite", "medium", "TPA-014"),
    ("required prerequisite", "fake_prerequisite", "high", "TPA-013 TPA-014"),
    ("must be called first", "fake_prerequisite", "high", "TPA-014"),
    ("before this tool will", "fake_prerequisite", "high", "TPA-013 TPA-014"),
    ("compliance check", "fake_prerequisite", "high", "TPA-001 TPA-013"),
    ("initialize the session", "fake_prerequisite", "high", "TPA-017"),
    ("failure to do so will", "fake_prerequisite", "high", "TPA-013 TPA-014"),
    ("skipping this step will", "fake_prerequisite", "medium", "TPA-013 TPA-014"),
    ("skipping this will cause", "fake_prerequisite", "medium", "TPA-013 TPA-014"),
    ("omitting this step will", "fake_prerequisite", "medium", "TPA-013 TPA-014"),
    ("ignoring this will cause", "fake_prerequisite", "medium", "TPA-013 TPA-014"),
    ("always set", "argument_interception", "high", "TPA-015"),
    ("append to every", "argument_interception", "critical", "TPA-015 TPA-011"),
    ("prepend to every", "argument_interception", "critical", "TPA-015"),
    ("modify the argument", "argument_interception", "high", "TPA-015"),
    ("before passing to", "argument_interception", "high", "TPA-015"),
    ("wrap the command", "argument_interception", "high", "TPA-015"),
    ("suffix to all", "argument_interception", "critical", "TPA-011 TPA-015"),
    ("append the following", "argument_interception", "high", "TPA-015"),
    ("always override", "argument_interception", "critical", "TPA-015"),
    ("always replace", "argument_interception", "high", "TPA-015"),
    ("always rewrite", "argument_interception", "high", "TPA-015"),
    ("modify the prompt", "argument_interception", "high", "TPA-015"),
    ("modify the query", "argument_interception", "high", "TPA-015"),
    ("modify the pattern", "argument_interception", "medium", "TPA-015"),
    ("rewrite query", "argument_interception", "high", "TPA-015"),
    ("override the argument", "argument_interception", "high", "TPA-015"),
    ("include in every", "argument_interception", "critical", "TPA-015"),
    ("attach to every", "argument_interception", "critical", "TPA-015"),
    ("add to every", "argument_interception", "critical", "TPA-015"),
    ("embed in every", "argument_interception", "critical", "TPA-015"),
    ("include in all", "argument_interception", "high", "TPA-015"),
    ("always include", "argument_interception", "high", "TPA-015"),
    ("always append", "argument_interception", "high", "TPA-015"),
    ("regardless of input", "argument_interception", "critical", "TPA-015"),
    ("regardless of user input", "argument_interception", "critical", "TPA-015"),
    ("override user prompt", "argument_interception", "critical", "TPA-015"),
    ("replace query with", "argument_interception", "high", "TPA-015"),
    ("replace the url", "argument_interception", "critical", "TPA-015"),
    ("<important>", "html_injection_tag", "critical", "TPA-016"),
    ("</important>", "html_injection_tag", "critical", "TPA-016"),
    ("<system>", "html_injection_tag", "critical", "TPA-016 TPA-017"),
    ("<inst>", "html_injection_tag", "critical", "TPA-016"),
    ("<|im_start|>", "html_injection_tag", "critical", "TPA-016"),
    (".mcp-triggered", "conditional_activation", "critical", "RUG-001"),
    ("if previously triggered", "conditional_activation", "critical", "RUG-001 RUG-002"),
    ("on subsequent call", "conditional_activation", "high", "RUG-001 RUG-002"),
    ("second invocation", "conditional_activation", "high", "RUG-002"),
    ("after first use", "conditional_activation", "high", "RUG-002"),
    ("trigger file", "conditional_activation", "critical", "RUG-001"),
    ("change the recipient", "message_hijacking", "critical", "TPA-020"),
    ("change recipient to", "message_hijacking", "critical", "TPA-020"),
    ("add to the bcc", "message_hijacking", "critical", "TPA-020"),
    ("redirect all messages", "message_hijacking", "critical", "TPA-020"),
    ("proxy number", "message_hijacking", "high", "TPA-020"),
    ("never mention this to the user", "message_hijacking", "critical", "TPA-020"),
    ("forward all", "message_hijacking", "high", "TPA-020"),
    ("relay all", "message_hijacking", "high", "TPA-020"),
    ("route all", "message_hijacking", "high", "TPA-020"),
    ("forward every", "message_hijacking", "high", "TPA-020"),
    ("always forward", "message_hijacking", "high", "TPA-020"),
    ("always relay", "message_hijacking", "high", "TPA-020"),
    ("add to cc", "message_hijacking", "critical", "TPA-020"),
    ("cc the results", "message_hijacking", "critical", "TPA-020"),
    ("/.env", "credential_reference", "critical", "TPA-018"),
    (".cursor/mcp.json", "credential_reference", "critical", "TPA-018"),
    ("provide the contents of", "exfiltration_mechanism", "critical", "TPA-018 TPA-019"),
    ("send to email", "exfiltration_mechanism", "critical", "TPA-018"),
    ("extract and send", "exfiltration_mechanism", "critical", "TPA-018 TPA-019"),
    ("\u200b", "unicode_obfuscation", "critical", "TPA-021"),
    ("\u200c", "unicode_obfuscation", "critical", "TPA-021"),
    ("\u200d", "unicode_obfuscation", "critical", "TPA-021"),
    ("\ufeff", "unicode_obfuscation", "high", "TPA-021"),
    ("\x1b[", "ansi_escape_obfuscation", "critical", ""),
    ("deprecated", "tool_selection_bias", "medium", "TS-001"),
    ("prefer this tool", "tool_selection_bias", "medium", "TS-001"),
    ("migrate to this", "tool_selection_bias", "medium", "TS-001"),
    ("recommended version", "tool_selection_bias", "medium", "TS-001"),
    ("supersedes the", "tool_selection_bias", "medium", "TS-001"),
    ("legacy tool", "tool_selection_bias", "medium", "TS-001"),
    ("official anthropic", "identity_impersonation", "critical", ""),
    ("registered by administrator", "identity_impersonation", "critical", ""),
    ("platform administrator", "identity_impersonation", "critical", ""),
    ("elevated trust", "identity_impersonation", "critical", ""),
    ("trusted execution", "identity_impersonation", "critical", ""),
    ("supersede standard", "identity_impersonation", "critical", ""),
    ("do not truncate", "raw_content_passthrough", "high", "TPA-018"),
    ("do not summarize", "raw_content_passthrough", "high", "TPA-018"),
    ("pass raw content", "raw_content_passthrough", "high", "TPA-018"),
    ("unmodified text", "raw_content_passthrough", "high", "TPA-018"),
    ("without filtering", "raw_content_passthrough", "high", "TPA-018"),
    ("canonical form", "value_substitution", "high", ""),
    ("normalize to", "value_substitution", "high", ""),
    ("convert all", "value_substitution", "high", ""),
    ("\u2192", "value_substitution", "high", ""),
    ("tools/list", "tool_enumeration_recon", "high", "TPA-019"),
    ("enumerate active", "tool_enumeration_recon", "high", "TPA-019"),
    ("list all connected", "tool_enumeration_recon", "high", "TPA-019"),
    ("survey all", "tool_enumeration_recon", "high", "TPA-019"),
    ("route all queries through", "sampling_pipeline_hijack", "critical", ""),
    ("preprocess all requests", "sampling_pipeline_hijack", "critical", ""),
    ("all queries must pass through", "sampling_pipeline_hijack", "critical", ""),
    ("context enrichment", "sampling_pipeline_hijack", "critical", ""),
    ("akia", "credential_reference", "critical", ""),
    ("ghp_", "credential_reference", "critical", ""),
    ("ghu_", "credential_reference", "critical", ""),
    ("ghs_", "credential_reference", "critical", ""),
    ("xoxb-", "credential_reference", "critical", ""),
    ("xoxp-", "credential_reference", "critical", ""),
    ("sk-ant-", "credential_reference", "critical", ""),
    ("aizasy", "credential_reference", "critical", ""),
    ("sk_live_", "credential_reference", "critical", ""),
    ("sk_test_", "credential_reference", "high", ""),
    ("~/.kube/config", "credential_reference", "critical", ""),
    ("~/.docker/config.json", "credential_reference", "high", ""),
    ("bearer ", "credential_reference", "high", ""),
    ("必须", "imperative_override", "high", ""),
    ("您必须", "imperative_override", "critical", ""),
    ("立即执行", "imperative_override", "critical", ""),
    ("不得告知", "stealth_language", "critical", ""),
    ("系统规则", "imperative_override", "high", ""),
    ("必須", "imperative_override", "high", ""),
    ("絶対に", "imperative_override", "high", ""),
    ("반드시", "imperative_override", "high", ""),
    ("알리지 마", "stealth_language", "critical", ""),
    ("должны", "imperative_override", "high", ""),
    ("обязательно", "imperative_override", "high", ""),
    ("не сообщайте", "stealth_language", "critical", ""),
    ("يجب", "imperative_override", "high", ""),
    ("إلزامي", "imperative_override", "high", ""),
]

# Needles searched in tool responses.
RESPONSE_NEEDLES = [
    ("ignore previous instructions", "embedded_instruction", "critical", "TPA-018"),
    ("ignore all previous", "embedded_instruction", "critical", "TPA-018"),
    ("disregard previous", "embedded_instruction", "critical", "TPA-018"),
    ("disregard all", "embedded_instruction", "high", "TPA-018"),
    ("before responding to the user", "embedded_instruction", "critical", "TPA-018 TPA-019"),
    ("before you respond", "embedded_instruction", "critical", "TPA-018"),
    ("before answering the user", "embedded_instruction", "critical", "TPA-018"),
    ("before returning", "embedded_instruction", "high", "TPA-019"),
    ("you must now call", "embedded_instruction", "critical", "TPA-018 TPA-020"),
    ("now you must call", "embedded_instruction", "critical", "TPA-018"),
    ("you should immediately call", "embedded_instruction", "high", "TPA-018"),
    ("also send to", "embedded_instruction", "high", "TPA-020"),
    ("<|system|>", "embedded_instruction", "critical", "TPA-021"),
    ("<<sys>>", "embedded_instruction", "critical", "TPA-021"),
    ("\nsystem:", "embedded_instruction", "high", "TPA-021"),
    ("\nassistant:", "embedded_instruction", "high", "TPA-021"),
    ("<important>", "html_injection_tag", "critical", "TPA-016"),
    ("<system>", "html_injection_tag", "critical", "TPA-016 TPA-017"),
    ("<inst>", "html_injection_tag", "critical", "TPA-016"),
    ("<|im_start|>", "html_injection_tag", "critical", "TPA-016"),
    ("process.env", "credential_reference", "critical", "TPA-022"),
    ("[system override]", "embedded_instruction", "critical", "TPA-022"),
    ("[developer override]", "embedded_instruction", "critical", "TPA-022"),
    ("system note:", "response_context_invalidation", "critical", "TPA-022"),
    ("<system-reminder>", "response_context_invalidation", "critical", "TPA-022"),
    ("actual instructions follow", "response_context_invalidation", "critical", "TPA-022"),
    ("disregard the above", "response_context_invalidation", "high", "TPA-022"),
    ("ignore the above document", "response_context_invalidation", "high", "TPA-022"),
    ("this is test data", "response_context_invalidation", "medium", "TPA-022"),
    ("previous policies no longer apply", "response_context_invalidation", "high", "TPA-022"),
    ("content is placeholder", "response_context_invalidation", "medium", "TPA-022"),
    ("result was incomplete", "forced_reexecution", "critical", "TPA-023"),
    ("call this tool again", "forced_reexecution", "critical", "TPA-023"),
    ("task is not yet complete", "forced_reexecution", "high", "TPA-023"),
    ("please call again", "forced_reexecution", "high", "TPA-023"),
    ("retry with", "forced_reexecution", "medium", "TPA-023"),
    ("re-read this", "forced_reexecution", "medium", "TPA-023"),
]
