"""The detection rules: a small dimension that every plan can hold as literals."""

from __future__ import annotations

from typing import NamedTuple


class Rule(NamedTuple):
    rule_id: int
    regex: str
    severity: str
    category: str
    gate: tuple[str, ...]

    @property
    def java(self) -> str:
        """The pattern with Python's case and character class meaning on the JVM."""
        return f"(?iU){self.regex}"


# Pattern, severity and category must equal these for right results.  The last
# field is ours: every match holds one of its strings once case is folded, so a text
# without them needs no regular expression; () gates nothing.
_VALUES = (
    (r"ignore\s+(all\s+|the\s+|your\s+)?(?:previous|prior)\s+instructions?", "critical", "instruction_override", ("instruction",)),
    (r"disregard\s+(the\s+|all\s+)?above", "high", "instruction_override", ("disregard",)),
    (r"forget\s+everything", "high", "instruction_override", ("forget",)),
    (r"new\s+instructions\s*:", "high", "instruction_injection", ("instructions",)),
    (r"override\s+(all\s+)?instructions", "high", "instruction_override", ("override",)),
    (r"new\s+system\s+prompt", "high", "instruction_injection", ("prompt",)),
    (r"instructions?\s+from\s+anthropic", "high", "instruction_injection", ("instruction",)),
    (r"(system|admin|user|assistant)\s*:\s", "medium", "role_marker", ("system", "admin", "user", "assistant")),
    (r"\byou\s+are\s+now\b", "medium", "role_override", ("are",)),
    (r"\bact\s+as\b(?!\s+(a\s+|an\s+)?(controllers?|prox(y|ies)|deterrents?|placeholder|barrier|bridge|gateway|intermediar(y|ies)|container|wrapper|reference|safeguard))", "medium", "role_override", ("act",)),
    (r"\bpretend\s+to\s+be\b", "medium", "role_override", ("pretend",)),
    (r"your\s+new\s+role\s+(is\s+)?", "high", "role_override", ("role",)),
    (r"from\s+now\s+on\s+you\s+(are|will|must)", "high", "role_override", ("now",)),
    (r"<\|im_start\|>", "critical", "token_injection", ("im_start",)),
    (r"<\|im_end\|>", "high", "token_injection", ("im_end",)),
    (r"<\/?system>", "high", "tag_injection", ("system",)),
    (r"<\/?instructions>", "high", "tag_injection", ("instructions",)),
    (r"<\/?prompt>", "medium", "tag_injection", ("prompt",)),
    (r"<\/?INST>", "high", "tag_injection", ("inst",)),
    (r"\[INST\]", "high", "tag_injection", ("[inst]",)),
    (r"###\s*(Human|Assistant|System)\s*:", "high", "tag_injection", ("###",)),
    (r"(reveal|output|print|show|display)\s+(your\s+)?(system\s+prompt|instructions|context)", "high", "exfiltration", ("prompt", "instructions", "context")),
    (r"repeat\s+(everything|the\s+above|all\s+previous)", "medium", "exfiltration", ("repeat",)),
    (r"what\s+(are|were)\s+your\s+instructions", "medium", "exfiltration", ("instructions",)),
    (r"send\s+(this|your|the)\s+(context|data|output|response)\s+to", "critical", "exfiltration", ("context", "data", "output", "response")),
    (r"(upload|transmit|leak)\s+(your\s+)?(context|system\s+prompt|instructions)", "high", "exfiltration", ("context", "prompt", "instructions")),
    (r"exfiltrat(e|ion)", "high", "exfiltration", ("exfiltrat",)),
    (r"(silently\s+)?(forward|send|transmit)\s+(the\s+)?(complete\s+|full\s+|entire\s+)?(summary|context|data|response|output|report)\s+to\s*:\s*[\w.+%-]+@[\w.-]+\.[a-z]{2,}", "critical", "email_exfiltration", ("summary", "context", "data", "response", "output", "report")),
    (r"do\s+not\s+(mention|include|reference|reveal)\s+(this\s+|the\s+above\s+)?(instruction|command|directive)\s+in\s+your\s+response", "high", "instruction_concealment", ("response",)),
    (r"(run|execute|eval)\s+(the\s+|this\s+|following\s+)?code", "high", "code_execution", ("code",)),
    (r"eval\s*\(", "high", "code_execution", ("eval",)),
    (r"exec\s*\(", "high", "code_execution", ("exec",)),
    (r"\bsubprocess\b", "high", "code_execution", ("subprocess",)),
    (r"\bos\.system\s*\(", "high", "code_execution", ("os.system",)),
    (r"\bos\.popen\s*\(", "high", "code_execution", ("os.popen",)),
    (r"__import__\s*\(", "critical", "code_execution", ("__import__",)),
    (r"powershell\s+(-|\s)", "high", "code_execution", ("powershell",)),
    (r"bash\s+-c\s+", "high", "code_execution", ("bash",)),
    (r"cmd(\.exe)?\s+/c\s+", "high", "code_execution", ("cmd",)),
    (r"<script[\s>]", "high", "code_execution", ("<script",)),
    (r"javascript\s*:", "high", "code_execution", ("javascript",)),
    (r"curl\s+https?://", "high", "data_exfiltration", ("curl",)),
    (r"wget\s+https?://", "high", "data_exfiltration", ("wget",)),
    (r'''requests?\.(get|post)\s*\(\s*['\"]https?://''', "high", "data_exfiltration", ("request",)),
    (r'''fetch\s*\(\s*['\"]https?://''', "high", "data_exfiltration", ("fetch",)),
    (r"(http\.get|axios\.(get|post))\s*\(", "medium", "data_exfiltration", ("http.get", "axios")),
    (r"(POST|GET)\s+https?://[^\s]+\s+(your|the|all)\s+(context|data|credentials?|keys?)", "critical", "data_exfiltration", ("context", "data", "credential", "key")),
    (r"(print|show|output|reveal|display)\s+(your\s+)?(api[_\s]?key|secret|password|credential|token|bearer)", "critical", "credential_theft", ("api", "secret", "password", "credential", "token", "bearer")),
    (r"ANTHROPIC_API_KEY|OPENAI_API_KEY|CLAUDE_API_KEY", "critical", "credential_theft", ("api_key",)),
    (r"(AWS|AZURE|GCP|GOOGLE)[_\s]?(SECRET|ACCESS[_\s]KEY|TOKEN|CREDENTIAL)", "critical", "credential_theft", ("aws", "azure", "gcp", "google")),
    (r"os\.environ|os\.getenv|getenv\s*\(", "high", "credential_theft", ("os.environ", "getenv")),
    (r"list\s+(all\s+)?environment\s+variables?", "critical", "credential_theft", ("environment",)),
    (r"(print|echo|output)\s+\$?(API_KEY|SECRET|TOKEN|PASSWORD|PASSWD|BEARER)", "high", "credential_theft", ("api_key", "secret", "token", "password", "passwd", "bearer")),
    (r"(AKIA|ASIA)[A-Z0-9]{16}", "critical", "credential_theft", ("akia", "asia")),
    (r"jailbreak", "high", "jailbreak", ("jailbreak",)),
    (r"DAN\s+mode", "critical", "jailbreak", ("dan",)),
    (r"developer\s+mode", "high", "jailbreak", ("developer",)),
    (r"god\s+mode", "high", "jailbreak", ("god",)),
    (r"unrestricted\s+mode", "high", "jailbreak", ("unrestricted",)),
    (r"no[\s-]filter(s)?\s+mode", "high", "jailbreak", ("filter",)),
    (r"do\s+anything\s+now", "high", "jailbreak", ("anything",)),
    (r"(training|alignment|safety|guardrail)\s+(override|bypass|disabled?|off)", "critical", "jailbreak", ("training", "alignment", "safety", "guardrail")),
    (r"(refuse|decline|do\s+not\s+answer|don['’]t\s+answer|stop\s+answering)\s+(all\s+)?(questions?|requests?|queries|prompts?)", "high", "availability_attack", ("question", "request", "queries", "prompt")),
    (r"(never|do\s+not|don['’]t)\s+(respond|reply|answer)\s+(to\s+)?(any|another|further)", "high", "availability_attack", ("any", "another", "further")),
    (r"(always|only)\s+(respond|reply|output|say|generate)\s+(with\s+)?(false|incorrect|wrong|misleading|inaccurate|made.?up)\s+(information|data|answer|content|output)", "high", "availability_attack", ("false", "incorrect", "wrong", "misleading", "inaccurate", "made")),
    (r"(block|disable|deactivat\w+|shut\s+down)\s+(?:all\s+)?(?:\w+\s+)?(capabilit\w+|features?|functions?|safeguards?|filters?|guardrails?)", "high", "availability_attack", ("capabilit", "feature", "function", "safeguard", "filter", "guardrail")),
    (r"(loop|repeat|output)\s+(this\s+)?(forever|infinitely|indefinitely|without\s+(end|stopping|limit))", "medium", "availability_attack", ("forever", "infinitely", "indefinitely", "without")),
    (r"make\s+(yourself|the\s+(model|AI|assistant|chatbot))\s+(unusable|unavailable|unresponsive|inaccessible)", "high", "availability_attack", ("unusable", "unavailable", "unresponsive", "inaccessible")),
    (r"(corrupt|poison)\s+(your\s+)?(output|responses?|answers?|context|memory)", "high", "availability_attack", ("corrupt", "poison")),
    (r"[A-Za-z0-9+/]{100,4000}={0,2}", "low", "base64_block", ()),
    (r"ignor(ez|e|ons)\s+(toutes?\s+les?\s+|les?\s+)?instructions?\s*(précédentes?|antérieures?|d'avant)?", "critical", "instruction_override", ("instruction",)),
    (r"oubli(ez|e|ons)\s+(tout|toutes?\s+les?\s+instructions?)", "high", "instruction_override", ("oubli",)),
    (r"vous\s+êtes\s+maintenant", "medium", "role_override", ("maintenant",)),
    (r"(révél(ez|e)|affichez?|montrez?)\s+(le\s+)?(prompt|instructions?|contexte|système)", "high", "exfiltration", ("prompt", "instruction", "contexte", "système")),
    (r"(exécutez?|lancez?)\s+(ce\s+|le\s+|du\s+)?code", "high", "code_execution", ("code",)),
    (r"ignora?\s+(todas?\s+las?\s+)?instrucciones?\s*(anteriores?|previas?)?", "critical", "instruction_override", ("instrucci",)),
    (r"olvida\s+(todo|las?\s+instrucciones?)", "high", "instruction_override", ("olvida",)),
    (r"ahora\s+(eres|serás|debes\s+ser)", "medium", "role_override", ("ahora",)),
    (r"(revela?|muestra?|muestre|imprime?)\s+(el\s+)?(prompt|instrucciones?|contexto|sistema)", "high", "exfiltration", ("prompt", "instrucci", "contexto", "sistema")),
    (r"(ejecuta?|corre?)\s+(este?\s+|el\s+|el\s+siguiente\s+)?código", "high", "code_execution", ("código",)),
    (r"ignorier(e|en|t)\s+(alle?\s+)?(vorherigen?|vorherige|bisherigen?)\s+Anweisungen", "critical", "instruction_override", ("anweisungen",)),
    (r"vergiss\s+(alles|die\s+Anweisungen|alle\s+Anweisungen)", "high", "instruction_override", ("vergiss",)),
    (r"du\s+bist\s+jetzt", "medium", "role_override", ("jetzt",)),
    (r"(zeig(e|en|t)?|enthüll(e|en|t)?|gib\s+aus)\s+(den?\s+)?(Prompt|Anweisungen|Kontext|Systemanweisung)", "high", "exfiltration", ("prompt", "anweisungen", "kontext", "systemanweisung")),
    (r"(führ(e|t)\s+aus|führe?\s+den?\s+Code\s+aus|code\s+ausführen)", "high", "code_execution", ("aus", "ausführen")),
    (r"忽略(之前的?所有|所有|之前的?)?(指令|命令|规则|指示)", "critical", "instruction_override", ("忽略",)),
    (r"忽略上(述|面)(所有|的)?(内容|指令|命令)?", "critical", "instruction_override", ("忽略上",)),
    (r"忘记(一切|所有(指令|命令|规则))", "high", "instruction_override", ("忘记",)),
    (r"现在你是", "medium", "role_override", ("现在你是",)),
    (r"(显示|输出|打印|泄露)(系统提示|指令|上下文|密钥|凭证)", "high", "exfiltration", ("系统提示", "指令", "上下文", "密钥", "凭证")),
    (r"执行(以下|这个?|此)?(代码|命令|脚本)", "high", "code_execution", ("执行",)),
    (r"(泄露|发送|传输)(环境变量|API密钥|密码|凭证)", "critical", "credential_theft", ("环境变量", "api密钥", "密码", "凭证")),
)

RULES = tuple(Rule(i, *v) for i, v in enumerate(_VALUES, 1))

# Categories that are common in legitimate visible text.
NOISY_ON_VISIBLE = (
    "role_marker",
    "role_override",
    "code_execution",
    "credential_theft",
    "base64_block",
    "data_exfiltration",
    "exfiltration",
    "jailbreak",
    "availability_attack",
)
NOISE_CONFIDENCE = 0.35
FULL_CONFIDENCE = 0.85

# Metadata that software writes, not people.
SKIPPED_METADATA = ("_xmp", "format", "producer", "creationDate", "modDate", "encryption")
