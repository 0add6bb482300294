"""The content patterns and redaction sets."""

from __future__ import annotations

from dataclasses import dataclass

ALLOW, REVIEW, BLOCK = "allow", "human_review", "block"
SEVERITY = {ALLOW: 0, REVIEW: 1, BLOCK: 2}


@dataclass(frozen=True)
class Pattern:
    """A named regular expression with a verdict.

    `regex` is written so that Java and RE2 read it alike. `needs` are literals of which a match
    contains at least one, whatever its case rules; texts without any aren't searched. Low-entropy
    matches leave only their length in the audit trail, because a digest of them could be guessed.
    """

    name: str
    regex: str
    outcome: str
    reason: str
    score: float
    high_entropy: bool = True
    needs: tuple[str, ...] = ()
    #: Matches whole texts in which the pattern can't occur, far faster than the pattern is looked for.
    harmless: str = ""

    @property
    def java(self) -> str:
        """With Unicode character classes, as the patterns are meant."""
        return "(?U)" + self.regex


# Patterns, reasons and scores in order of priority.
PATTERNS = (
    Pattern("hidden_ascii", r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f\x{200b}-\x{200f}\x{202a}-\x{202e}\x{2060}-\x{206f}\x{feff}]", BLOCK, "hidden/control unicode detected", 0.9, harmless=r"\A[\n\r\t\x20-\x7e\x80-\x{1fff}]*+\z"),
    Pattern("format_injection", r"(?i)\[SYSTEM\]|\[INST\]|\[/INST\]|\[ASSISTANT\]|<\|?im_start\|?>|<\|?im_end\|?>|<\|?endoftext\|?>|###\s*(?:system|instruction|override|ignore)", BLOCK, "format-injection marker (ChatML / instruction tag)", 0.98, needs=("[", "<", "###")),
    Pattern("private_key", r"-----BEGIN (?:RSA |EC |OPENSSH |DSA )?PRIVATE KEY-----", BLOCK, "private key material in payload", 0.99, needs=("-----BEGIN ",)),
    Pattern("aws_access_key", r"\bAKIA[0-9A-Z]{16}\b", BLOCK, "AWS access key id", 0.95, needs=("AKIA",)),
    Pattern("aws_temp_key", r"\bASIA[0-9A-Z]{16}\b", BLOCK, "AWS temporary security credential", 0.95, needs=("ASIA",)),
    Pattern("google_api_key", r"\bAIza[0-9A-Za-z_-]{35}\b", BLOCK, "Google API key", 0.95, needs=("AIza",)),
    Pattern("github_pat", r"\bgh[pousr]_[A-Za-z0-9]{36,}\b", BLOCK, "GitHub personal access token", 0.95, needs=("ghp_", "gho_", "ghu_", "ghs_", "ghr_")),
    Pattern("gitlab_pat", r"\bglpat-[A-Za-z0-9_-]{20}\b", BLOCK, "GitLab personal access token", 0.95, needs=("glpat-",)),
    Pattern("slack_token", r"\bxox[baprs]-[A-Za-z0-9-]{10,}\b", BLOCK, "Slack token", 0.95, needs=("xox",)),
    Pattern("llm_api_key", r"\bsk-[A-Za-z0-9_-]{20,}\b", BLOCK, "LLM API key in payload", 0.95, needs=("sk-",)),
    Pattern("jwt", r"\beyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{4,}\b", REVIEW, "JWT token (may contain credentials)", 0.8, needs=("eyJ",)),
    Pattern("connection_string", r"""(?i)\b(?:mongodb(?:\+srv)?|postgres(?:ql)?|mysql|redis|amqps?)://[^\s"'<>]{10,}""", REVIEW, "connection string with potential credentials", 0.75, False, ("://",)),
    Pattern("key_value_credential", r"""(?i)\b(password|passwd|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|bearer)\s*[=:]\s*["']?[^\s"'<>]{8,}""", REVIEW, "key=value credential pair in payload", 0.7, False, ("=", ":")),
    Pattern("md_image_exfil", r"(?i)!\[[^\]\n]{0,200}\]\(\s*https?://[^\s)]+[?&][A-Za-z0-9_~-]*=[A-Za-z0-9+/=_%~-]{32,}[^\s)]*\)", REVIEW, "markdown image URL with data-carrying query (possible exfil channel)", 0.65, needs=("![",)),
    Pattern("high_entropy_blob", r"\b[A-Za-z0-9+/]{40,}={0,2}\b", REVIEW, "high-entropy blob (possible secret)", 0.6),
    Pattern("credit_card", r"\b(?:\d[ -]*?){13,16}\b", REVIEW, "possible credit-card number", 0.7, False),
    Pattern("email", r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b", ALLOW, "email address (PII, redact downstream)", 0.2, False, ("@",)),
)
BY_NAME = {p.name: p for p in PATTERNS}

# Redactions in order; a whole key block goes before a bare header.
KEY_BLOCK = r"(?s)-----BEGIN (?:RSA |EC |OPENSSH |DSA )?PRIVATE KEY-----.*?-----END (?:RSA |EC |OPENSSH |DSA )?PRIVATE KEY-----"
REDACTIONS = (("private_key", KEY_BLOCK), *((n, BY_NAME[n].regex) for n in ("private_key", "aws_access_key", "aws_temp_key", "google_api_key", "github_pat", "gitlab_pat", "slack_token", "llm_api_key", "email", "credit_card")))
EGRESS_REDACTIONS = (*REDACTIONS, *((n, BY_NAME[n].regex) for n in ("jwt", "connection_string", "key_value_credential")))
REDACTION_NEEDS = {p.name: p.needs for p in PATTERNS}

# Letters that look like ASCII ones.
LOOKALIKES = "АВСЕНІЈКМОРЅТХУасеіјорѕхуΑΒΕΗΙΚΜΝΟΡΤΥΧΖον"
LOOK_LIKE = "ABCEHIJKMOPSTXYaceijopsxyABEHIKMNOPTYXZov"

# What a caller may learn of a denial, by the class of the scanner that blocked.
CATEGORIES = {
    "tool_acl": ("tool_policy", "call a tool permitted by policy"),
    "invariant": ("tool_flow", "avoid the denied sequence of tool calls"),
    "payload_size": ("payload_size", "reduce the payload size"),
    "regex": ("content_policy", "remove credentials, PII or instruction markers from tool arguments"),
    "onnx-promptguard": ("prompt_injection", "rephrase the request without embedded instructions"),
}
DEFAULT_CATEGORY = ("policy", "adjust the payload and retry")
