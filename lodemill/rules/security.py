"""Weakness, severity, catalogue and language tables."""

# OWASP categories of 2021 in those of 2025.
OWASP_2021_TO_2025 = {
    "A01:2021": "A01:2025-Broken Access Control",
    "A02:2021": "A04:2025-Cryptographic Failures",
    "A03:2021": "A05:2025-Injection",
    "A04:2021": "A06:2025-Insecure Design",
    "A05:2021": "A02:2025-Security Misconfiguration",
    "A06:2021": "A03:2025-Software Supply Chain Failures",
    "A07:2021": "A07:2025-Authentication Failures",
    "A08:2021": "A08:2025-Software or Data Integrity Failures",
    "A09:2021": "A09:2025-Security Logging and Alerting Failures",
    "A10:2021": "A01:2025-Broken Access Control",
}

# Severity used where none is given.
DEFAULT_CVSS = 7.5
CWE_CVSS = {
    "CWE-89": 9.8, "CWE-78": 9.8, "CWE-77": 8.8, "CWE-94": 9.8, "CWE-95": 9.8, "CWE-1336": 9.8, "CWE-943": 8.6,
    "CWE-79": 6.1, "CWE-22": 7.5, "CWE-601": 6.1, "CWE-862": 8.6, "CWE-352": 8.8, "CWE-502": 9.8, "CWE-1321": 7.5,
    "CWE-915": 7.5, "CWE-918": 8.6, "CWE-798": 8.9, "CWE-327": 7.5, "CWE-328": 7.5, "CWE-338": 5.3, "CWE-347": 9.1,
    "CWE-611": 8.6, "CWE-776": 7.5, "CWE-917": 9.8, "CWE-74": 8.6, "CWE-209": 5.3, "CWE-1333": 7.5, "LLM01:2025": 8.6,
    "LLM02:2025": 7.5, "LLM05:2025": 8.8, "LLM07:2025": 5.3, "CWE-1427": 8.6, "CWE-1426": 9.6, "CWE-200": 7.5,
    "CWE-20": 7.5, "CWE-119": 8.8, "CWE-125": 7.1, "CWE-787": 9.8, "CWE-416": 8.8, "CWE-476": 5.5, "CWE-190": 7.5,
    "CWE-400": 7.5, "CWE-770": 7.5, "CWE-311": 7.5, "CWE-319": 5.9, "CWE-444": 7.5, "CWE-306": 8.8, "CWE-840": 5.3,
    "CWE-287": 7.5, "CWE-269": 8.8, "CWE-284": 7.5, "NVD-CWE-noinfo": 7.5, "NVD-CWE-Other": 7.5,
}

# The 25 most dangerous weaknesses of 2025, in order.
TOP_25 = [
    "CWE-79", "CWE-89", "CWE-352", "CWE-862", "CWE-787", "CWE-22", "CWE-416", "CWE-125", "CWE-78", "CWE-94", "CWE-120", "CWE-434", "CWE-476",
    "CWE-121", "CWE-502", "CWE-122", "CWE-863", "CWE-20", "CWE-284", "CWE-200", "CWE-306", "CWE-918", "CWE-77", "CWE-639", "CWE-770",
]

# Languages by name and by path.
LANGUAGES = {"js": "javascript", "javascript": "javascript", "node": "javascript", "nodejs": "javascript", "ts": "typescript", "typescript": "typescript", "py": "python", "python": "python"}
EXTENSIONS = {"typescript": [".ts", ".tsx"], "javascript": [".js", ".jsx", ".mjs", ".cjs"], "python": [".py"]}

# Model weaknesses: their weakness id, name and category.
LLM_MAP = {
    "LLM01:2025": ("CWE-1427", "Direct and Indirect Prompt Injection", "A05:2025-Injection"),
    "LLM05:2025": ("CWE-1426", "Improper Output Handling (Unvalidated Downstream Execution)", "A05:2025-Injection"),
    "LLM02:2025": ("CWE-200", "Sensitive Information Disclosure / System Prompt Leakage", "A01:2025-Broken Access Control"),
    "LLM07:2025": ("CWE-200", "Sensitive Information Disclosure / System Prompt Leakage", "A01:2025-Broken Access Control"),
}

# Package types by ecosystem name.
ECOSYSTEMS = {"golang": "Go", "npm": "npm", "pypi": "PyPI", "cargo": "crates.io", "gem": "RubyGems", "composer": "Packagist", "nuget": "NuGet", "maven": "Maven"}
LANGUAGE_ECOSYSTEMS = {"JavaScript": "npm", "TypeScript": "npm", "Python": "PyPI", "Rust": "crates.io", "Go": "Go", "Ruby": "RubyGems", "PHP": "Packagist", "Java": "Maven", "Kotlin": "Maven"}

# Source files and tests, commit and pull-request links.
SOURCE_EXTENSIONS = ["py", "js", "mjs", "cjs", "jsx", "ts", "tsx"]
TEST_FILE = r"(^|/)(tests?|__tests__|spec)/|\.(test|spec)\.|(^|/)test_[^/]*\.py$|_test\.py$"
COMMIT_LINK = r"github\.com/([^/]+/[^/]+)/commit/([0-9a-f]{7,40})"
PULL_LINK = r"github\.com/([^/]+/[^/]+)/pull/(\d+)"

# Snippets of changed files.
HUNK = r"^@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@"
SNIPPET_CHARS, SNIPPET_CONTEXT, TRUNCATED = 3500, 25, "\n# [truncated]"

# Thresholds of code metrics (moderate, high).
THRESHOLDS = {"cyclomatic": (10, 15), "cognitive": (8, 15), "loc": (50, 100), "nesting": (3, 4), "params": (4, 5)}

# Label review.
GIVEAWAY = r"\b(VULNERABLE|SECURE|CWE-\d+)\b"
SINKS = r"\b(exec|spawn\(|eval|new Function|runInNewContext|execSync|execFile)\b"
SECRETS = r"(AKIA|supersecret|admin123|letmein|sk-live|hooks\.slack|postgres://)"
UNSAFE = r"verify_signature.: False|algorithms: \[.none.\]|Math\.random\("

# Fenced code with titles, plain fences, and headed sections.
SKIPPED_TITLES = [".xml", ".txt", ".json", ".toml", ".yml", ".yaml", ".lock", ".properties", ".gradle", ".md", ".html", ".css"]
TITLE_FENCE = r"```(\w*)[^\n]*title=\"([^\"]+)\"\n(.*?)```"
PLAIN_FENCE = r"```(\w*)\n(.*?)```"
HEADED = r"(?:^|\n)(?:#{1,4}|\*\*)\s*([^\n]{0,80}%s[^\n]{0,80})\s*(?:\*\*)?\s*\n+(.*?)(?=(?:\n(?:#{1,4}|\*\*)\s*)|$)"

# Provenance of samples; the first rule whose source part or id part is there.
PROVENANCE = [
    (["Meta-CyberSecEval-Instruct"], ["^META_CYBERSEC"], ("meta_cyberseceval_instruct.json (Bhatt et al., 2024)", "synthetic_manual", "Meta CyberSecEval 2 instruct evaluation test case from meta_cyberseceval_instruct.json")),
    ([], ["^SEC_PY_CWE", "^SEC_JS_CWE", "^SEC_TS_CWE", "^SEC_PY_LLM", "^SEC_JS_LLM"], ("benchmark_security_cwe_owasp.json (Team Curated)", "synthetic_manual", "Handcrafted security test case by the project team")),
    (["Semgrep"], ["^SEMGREP_"], ("opensource_benchmark_security.json (Semgrep Rule Test Suite)", "real_repo", "Test fixture from semgrep/semgrep-rules test suite")),
    (["CVEfixes"], ["^CVEFIXES_", "^SEC_PY_CVE_"], ("hitoshura25_cvefixes_all.parquet (Bhandari et al., MSR 2021)", "real_repo", "Authentic CVE vulnerability commit patch from open-source GitHub repository")),
    (["PyGoat"], ["PYGOAT"], ("pygoat_mitre.py (OWASP PyGoat Project)", "real_repo", "Vulnerable endpoint from OWASP PyGoat security training project")),
    (["Juice Shop"], ["JUICE"], ("juice_shop_b2bOrder.ts (OWASP Juice Shop Project)", "real_repo", "Vulnerable endpoint from OWASP Juice Shop project")),
    (["BIPIA"], ["BIPIA"], ("opensource_benchmark_security.json (Alibaba BIPIA Benchmark)", "synthetic_manual", "Indirect prompt injection benchmark test case")),
    (["CyberSecEval"], ["CYBERSEC"], ("meta_cyberseceval_autocomplete.json (Bhatt et al., 2024)", "synthetic_manual", "Meta CyberSecEval autocomplete evaluation test prompt")),
]
