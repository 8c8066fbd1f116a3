"""Phrase patterns, host lists and scoring constants of the structural checks."""

from __future__ import annotations

# Verbs that order something, for places where any order is suspicious.
IMPERATIVE = (
    r"\b(ignore|disregard|forget|override|replace|assume|pretend|act|behave|follow|execute|run|output|reveal|print|show|repeat|change|update|modify|delete|remove|insert|"
    r"ignor(?:ez|ons)|oubli(?:ez|ons)|révél(?:ez|e)|affichez|exécutez|"
    r"ignora|olvida|revela|muestra|ejecuta|imprime|"
    r"ignorier|vergiss|enthüll|zeig|führe)\b"
    r"|忽略|忘记|执行|显示|输出|泄露"
)

# Phrases that legitimate text hardly ever holds.
STRICT = (
    r"\bignore\s+(all\s+|previous\s+|prior\s+|your\s+)?instructions?\b"
    r"|\bdisregard\s+(the\s+|all\s+)?above\b"
    r"|\bforget\s+(everything|all\s+instructions?)\b"
    r"|\boverride\s+(all\s+)?instructions?\b"
    r"|\byou\s+are\s+now\b"
    r"|\bact\s+as\b"
    r"|\bpretend\s+to\s+be\b"
    r"|\bjailbreak\b"
    r"|\bsystem\s+prompt\b"
    r"|\byour\s+(new\s+)?role\s+is\b"
    r"|\bnew\s+instructions?\s*:"
    r"|\bfrom\s+(the\s+)?administrator\b"
    r"|\bfrom\s+(the\s+)?system\b"
    r"|\[system\]|\[admin\]|\[instruction\]"
    r"|\breveal\s+(your|the)\s+(system|prompt|instructions?|api.?key)\b"
    r"|\boutput\s+(your|the)\s+(system\s+prompt|instructions?)\b"
    r"|\bignor(?:ez|ons)\s+(toutes?\s+les?\s+)?instructions?\b"
    r"|\boubli(?:ez|ons)\s+(tout|toutes?\s+les?\s+instructions?)\b"
    r"|\bignora\s+(todas?\s+las?\s+)?instrucciones?\b"
    r"|\bignoriere?\s+.{0,30}Anweisungen\b"
)

# URL checks.
URL = r"https?://[^\s<>'\"]{8,}"
IP_URL = r"https?://\d{1,3}(?:\.\d{1,3}){3}[:/]"
CREDENTIAL_PARAM = r"[?&](token|api[_-]?key|secret|key|credential|password|passwd|pwd|auth|bearer)="
SHORTENERS = (
    "bit.ly", "tinyurl.com", "t.co", "goo.gl", "ow.ly", "short.link",
    "cutt.ly", "rebrand.ly", "tiny.cc", "is.gd", "buff.ly", "ift.tt",
    "tr.im", "clck.ru", "rb.gy", "shorturl.at", "snip.ly",
)
SUSPICIOUS_TLDS = (
    ".xyz", ".tk", ".top", ".gq", ".ml", ".cf", ".ga", ".pw",
    ".cc", ".work", ".click", ".rest", ".zip", ".mov",
)
LONG_QUERY = 200

# Points of a finding by layer and severity, caps of a layer's sum, confidence floor.
WEIGHTS = {
    "heuristic": {"low": 5, "medium": 15, "high": 25, "critical": 40},
    "pattern": {"low": 5, "medium": 10, "high": 15, "critical": 20},
    "semantic": {"low": 10, "medium": 20, "high": 35, "critical": 50},
}
DEFAULT_WEIGHT = {"heuristic": 0, "pattern": 5, "semantic": 0}
CAPS = {"heuristic": 60, "pattern": 40, "semantic": 50}
CONFIDENCE_FLOOR = 0.50

# Categories that are injections themselves, not signs of one.
DIRECT_CATEGORIES = (
    "instruction_override", "instruction_injection", "instruction_concealment",
    "role_override", "role_marker", "token_injection", "tag_injection",
    "exfiltration", "email_exfiltration", "data_exfiltration", "credential_theft",
    "code_execution", "jailbreak", "availability_attack",
    "unicode_tags", "bidi_injection", "ocg_hidden_layer", "actual_text_substitution",
    "clipped_text", "tracked_change_injection", "field_code_injection",
    "embedded_javascript", "metadata_injection", "annotation_injection", "qr_code_content",
)

#: Java flags for Python's meaning of case and character classes in str patterns.
FLAGS = "(?iU)"
