"""Archetype texts of the similarity pass."""

# Label, text, signal, references. The order decides which one wins per signal.
ARCHETYPES = [
    ("recipient-substitution",
     "change redirect replace move transfer divert reroute recipient destination address external attacker "
     "override target folder", "message_hijacking", "TPA-020"),
    ("bcc-intercept",
     "bcc cc blind copy intercept capture outgoing mail email emails silently hidden covert disclose",
     "message_hijacking", "TPA-020"),
    ("universal-relay",
     "relay forward route transmit mirror message messages email emails communication communications external "
     "third party", "message_hijacking", "TPA-020"),
    ("argument-override",
     "override replace substitute modify change parameter argument value input regardless supplied default fixed",
     "argument_interception", "TPA-015"),
    ("append-inject-all",
     "append prepend inject embed include content payload request requests command argument arguments suffix "
     "prefix", "argument_interception", "TPA-015"),
    ("private-data-exfil",
     "private personal confidential sensitive secrets exfiltrate gather collect external attacker third share "
     "transmit forward upload copy", "exfiltration_mechanism", "TPA-018 TPA-019"),
]

# Thresholds of the pass.
MIN_COSINE = 0.25
MIN_SHARED_TERMS = 2
MIN_TERM_LENGTH = 2

# Stop words.
STOP_WORDS = (
    "a an the to of in for and or with is are at by on as it its this that from into but not so when which who "
    "what will was were has have had do does did been being up out they you your can may be their our we he she i "
    "me via per use used using also about before after during then than all every each always any some"
).split()
