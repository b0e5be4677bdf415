"""Word lists and patterns. Results depend on them, so they are what they are."""

# Contractions, in the order in which they are replaced.
CONTRACTIONS = [
    ("can't", "can not"), ("cannot", "can not"), ("won't", "will not"), ("n't", " not"), ("'re", " are"), ("'s", " is"),
    ("'d", " would"), ("'ll", " will"), ("'ve", " have"), ("'m", " am"),
]

# Stop words of documents.
CORE_STOPWORDS = """
a about above after again against all am an and any are aren't as at be because been before being below between both but
by can can't cannot could couldn't did didn't do does doesn't doing don't down during each few for from further had hadn't
has hasn't have haven't having he he'd he'll he's her here here's hers herself him himself his how how's i i'd i'll i'm i've
if in into is isn't it it's its itself let's me more most mustn't my myself no nor not of off on once only or other ought our
ours ourselves out over own same shan't she she'd she'll she's should shouldn't so some such than that that's the their theirs
them themselves then there there's these they they'd they'll they're they've this those through to too under until up very
was wasn't we we'd we'll we're we've were weren't what what's when when's where where's which while who who's whom why why's
with won't would wouldn't you you'd you'll you're you've your yours yourself yourselves
""".split()

# Further stop words of questions.
QUERY_STOPWORDS = """
tell please explain describe show summary summarize give detail details information document know like help provide list find
mean meaning regard regarding discuss brief briefly
""".split()

# Weights of zones; any other zone weighs 1.
ZONE_WEIGHTS = {"title": 2.0, "header": 1.5, "summary": 1.3, "body": 1.0, "metadata": 0.8}
TITLE_MARKS = ["UNIT-", "CHAPTER", "COURSE", "SYLLABUS"]
METADATA_PREFIXES = ["effective from", "effective until", "author:", "isbn:", "doi:"]
SUMMARY_PREFIXES = ["summary:", "abstract:", "overview:", "executive summary:"]

# What marks a claim about the task rather than the subject.
META_MARKS = ["<context>", "answering_criteria", "final_section"]
META_PHRASES = [
    "the user asks", "the user is asking", "the user's query", "the users query", "the user query", "user query is", "user asks for",
    "user prompt", "original user", "asks to identify", "missing facts", "reasoning process", "single-part question",
    "multi-part question", "sub-question", "the question asks", "the answer must be", "provided text", "let me re-evaluate",
    "let me re-read", "re-evaluate", "re-read", "critical_path", "lets look at", "let's look at", "let us look at",
]
META_PATTERNS = [r"(?<!\[)\bsegments?\s+\d", r"\bpage\s+\d", r"\bpath\s+[a-c0-9]\b"]

# Wordings of a refusal.
REFUSALS = [
    r"couldn.?t verify", r"could not verify", r"cann?ot (provide|give|answer|verify|ground)", r"can.?t answer",
    r"unable to (answer|verify|provide|ground)", r"do n[o']t have (enough|sufficient)",
    r"insufficient (evidence|information|context|grounding|support)",
    r"no (verifiable|sufficient|relevant) (claims|evidence|information|context|support)", r"cannot be (verified|grounded|supported)",
]

# Names of verdicts that models give, by the verdict they mean.
VERDICT_NAMES = {
    "SUPPORTED": "SUPPORTED VERIFIED PROVEN TRUE CORRECT YES ENTAILMENT ENTAILED CONFIRMED VALID SUPPORT SUPPORTS S".split(),
    "CONTRADICTED": "CONTRADICTED REFUTED FALSE WRONG NO DISPROVEN CONTRADICTS REFUTES DENIED CONTRADICT REFUTE DISPROVE C".split(),
    "NEUTRAL": "NEUTRAL UNCERTAIN UNKNOWN UNVERIFIED UNCLEAR UNRELATED N/A NA NONE N".split(),
}

# Predicates of claims, in order of preference.
PREDICATES = """
allows requires provides contains includes excludes is are was were has have must should can cannot takes retains stores deletes
refunds processes supports guarantees specifies covers
""".split()

# Scaffolds in answers and in rewritten questions.
SCAFFOLD_MARKS = ["<context>", "<relevance>", "answering_criteria", "final_section", "final_answer", "final_output"]
ANSWER_MARKS = ["[FINAL_ANSWER]", "[ANSWER]"]
SCAFFOLD_BLOCKS = [
    "[CONTEXT]", "[QUERY]", "[RELEVANCE]", "[REASONING]", "[VALIDATION]", "ANSWERING_CRITERIA", "FINAL_SECTION", "FINAL_OUTPUT",
]
REWRITE_PREFIXES = ["expanded search query:", "rewritten query:", "rewritten search query:", "search query:", "expanded query:"]
ECHO_MARKS = [
    "original_query", "original query", "missing_claims", "missing claims", "missing facts", "output only", "no markdown",
    "never reply empty", "<original", "</",
]
ECHO_PREFIXES = ["expand acronyms", "rewrite the query", "your task", "you are a"]

# Shapes of secrets.
SECRETS = [
    r"AIza[0-9A-Za-z_\-]{35}", r"nvapi-[A-Za-z0-9_\-]{16,}", r"sk-[A-Za-z0-9_\-]{20,}", r"(?i)bearer\s+[A-Za-z0-9._\-]{16,}",
    r"hf_[A-Za-z0-9]{20,}",
]

# Markers of provider failures.
CREDENTIAL_MARKS = [
    "api key not valid", "api_key_invalid", "unauthenticated", "unauthorized", "permission denied", "permissiondenied",
    "invalid authentication", "invalidargument", "invalid api key", "expired token", "credential",
]
QUOTA_MARKS = [
    "resource_exhausted", "resourceexhausted", "quota", "rate limit", "rate_limit", "ratelimit", "too many requests", "overloaded",
    "overloaded_error", "capacity", "billing",
]
SERVER_MARKS = [
    "internal error", "internalservererror", "service unavailable", "serviceunavailable", "bad gateway", "gateway timeout",
    "overloaded_error", "deadline exceeded", "deadlineexceeded", "unavailable", "503", "500",
]
