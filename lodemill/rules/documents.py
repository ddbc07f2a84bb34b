"""Path, text and keyword rules of the documentation operators."""

# Why a document has no topic, and what is said of each reason.
NO_CLEAR_TOPIC = "No clear topic"
UNASSIGNED = {
    "Not modeled: empty file": "The file has no content.",
    "Not modeled: excluded path or file type": "Not documentation: vendored code, test fixtures, agent run logs, non-English translation folders, or a .txt file other than readme.txt / llms.txt.",
    "Not modeled: non-English or no prose": "The text is not English, or nothing readable remains after removing code, markup and links.",
    NO_CLEAR_TOPIC: "English documentation that is not similar enough to any topic (cosine similarity below the threshold).",
}

# Markup rules, in order; flags are those of the pattern (i, m, s).
FENCE = r"^[ \t]*(`{3,}|~{3,})[^\n]*\n.*?^[ \t]*\1[ \t]*$"
FRONT_MATTER = r"\A---[ \t]*\n(.*?)\n---[ \t]*(?:\n|\Z)"
FRONT_MATTER_TEXT = r"^(?:title|name|description|summary):[ \t]*[\"']?(.*?)[\"']?[ \t]*$"
MARKUP = [
    ("is", r"(?:\.\.\s*)?Licensed\s+(?:to|under)\s.{0,1500}?limitations\s+under\s+the\s+License\.?", " "),
    ("m", r"^[ \t]*(?:import\s.+\sfrom\s.+|export\s+(?:const|default|function)\b.*)$", " "),
    ("s", r"<!--.*?-->", " "),
    ("", r"</?[A-Za-z][^<>]*>", " "),
    ("", r"!?\[([^\]]*)\]\([^)]*\)", "$1"),
    ("", r"https?://\S+", " "),
    ("m", r"^[ \t|:+-]+$", ""),
    ("", r"[ \t]{2,}", " "),
]
HEADING = r"^[ \t]{0,3}#{1,6}[ \t]+(?P<md>.+?)[ \t#]*$|^(?P<rst>\S.*)\n([=~^\"'`#*+-])\3{2,}[ \t]*$"
OUTLINE_CHARS, TEXT_CHARS = 500, 4000

# The English gate.
FUNCTION_WORDS = "the and of to is are in for with this that you your it be on can will from by or as an not use".split()
ASCII_SHARE, FUNCTION_SHARE = 0.95, 0.02

# Paths that are no documentation.
EXCLUDED_PATH = (
    r"(?:^|/)(?:third[_-]party|vendor|node_modules|\.omo/evidence|__fixtures__|fixtures|test-fixtures|__snapshots__|snapshots|testdata)/"
    r"|(?:^|/)(?:translations|i18n|locales?|l10n)/(?!en(?:[-_][a-z]+)?/)[^/]+/"
)
TXT_NAMES = ["readme.txt", "llms.txt", "llms-full.txt"]

# Document types by file name, then by folder; the first that matches.
START = r"(^|/)"
DOC_TYPES = [
    ("Changelog / release notes", START + r"((change-?log|release[-_ ]?notes)([-_.][^/]*)?|(changes|history|news)(\.[a-z]+)?)$"),
    ("Contributing guide", START + r"contribut(ing|e|ions?)([-_.][^/]*)?$"),
    ("Issue / PR template", START + r"(pull_request_template|bug_report|feature_request)[^/]*$"),
    ("Code of conduct", START + r"code[-_]of[-_]conduct[^/]*$"),
    ("Security policy", r"^(\.github/)?security\.mdx?$"),
    ("License / notice", START + r"(licen[cs]e|notice|copying)([-_.][^/]*)?$"),
    ("Build / dependency file", START + r"(requirements[^/]*\.txt|cmakelists\.txt)$"),
    ("Agent skill", START + r"skill\.md$"),
    ("Agent instructions", START + r"((?-i:AGENTS|CLAUDE|GEMINI)\.md|copilot-instructions\.md)$"),
    ("README", START + r"readme[^/]*$"),
    ("Agent run log / test output", START + r"test[-_]?(logs?|reports?|results?)([-_.][^/]*)?$"),
    ("Plan / spec / design record", START + r"(plan|spec|prd|roadmap)\.mdx?$"),
    ("Overview / introduction page", START + r"(overview|introduction|intro|home|welcome)\.mdx?$"),
    ("Getting started / installation", START + r"((getting[-_]started|get[-_]started|quick[-_]?start|installation|install|setup|onboarding)[-_.]|first[-_])[^/]*$"),
    ("Deployment / self-hosting", START + r"(deploy(ment|ing)?s?|self[-_]?host(ing|ed)?|hosting)[-_.][^/]*$"),
    ("Migration / upgrade guide", START + r"[^/]*(migrat|upgrad)[^/]*$"),
    ("FAQ / troubleshooting", START + r"[^/]*(faq|troubleshoot)[^/]*$"),
    ("Reference (API, CLI, configuration)", START + r"([^/]*api[-_]?reference[^/]*|([\w-]*reference|api|sdk|cli|commands|configuration|config|glossary)\.mdx?)$"),
    ("Snippet / partial", START + r"(_[^/]+\.mdx?|snippet-[^/]*)$"),
    ("Design system / style guide", START + r"(design\.md|style[-_]?guide[^/]*)$"),
    ("Changelog / release notes", START + r"(change-?logs?|releases|release-notes|\.changeset|newsfragments)/"),
    ("Issue / PR template", START + r"(issue_template|pull_request_template)/"),
    ("Vendored third-party file", START + r"(third[_-]party|vendor|node_modules)/"),
    ("Agent run log / test output", START + r"(\.omo/evidence|evidence|runs)/"),
    ("Test file / fixture", START + r"(__fixtures__|fixtures|test-fixtures|testdata|test-data|__snapshots__|snapshots|tests?)/"),
    ("Translated page", START + r"(translations|i18n|locales?|l10n)/(?!en([-_][a-z]+)?/)[^/]+/"),
    ("Agent skill", START + r"skills/"),
    ("Agent definition / command", START + r"\.[\w-]+/(agents|commands?|prompts)/"),
    ("Prompt / rule file", START + r"(prompts?|rules)/"),
    ("Example / tutorial", START + r"(examples?|cookbooks?|samples?|tutorials?|demos?)/"),
    ("Plan / spec / design record", START + r"\.?(adrs?|rfcs?|plans?|specs?|proposals|design-docs)/"),
    ("Report / analysis", START + r"(reports?|analysis|research|benchmarks?|experiments?|evals?)/"),
    ("Blog post / announcement", START + r"(blog|posts|announcements?)/"),
    ("Snippet / partial", START + r"(snippets?|partials?|_partials?|includes?)/"),
    ("Migration / upgrade guide", START + r"[^/]*(migrat|upgrad)[^/]*/"),
    ("FAQ / troubleshooting", START + r"(faq|troubleshooting)/"),
    ("Getting started / installation", START + r"(getting[-_]started|get[-_]started|quick[-_]?start|installation|install|setup|onboarding)/"),
    ("Deployment / self-hosting", START + r"(deploy(ment|ing)?s?|self[-_]?host(ing|ed)?|hosting)/"),
    ("Tool / integration page", START + r"(tools?|integrations?|providers?|plugins?|connectors?|toolkits?|extensions?|channels?|pieces|bundles|models)/"),
    ("Concept / explanation", START + r"(concepts?|core[-_]concepts|architecture|explanations?|fundamentals)/"),
    ("Guide / how-to", START + r"(guides?|how[-_]?to|learn|recipes|advanced|use[-_]cases|user[-_]guide|features?)/"),
    ("Reference (API, CLI, configuration)", START + r"([\w-]*reference|api|api[-_]docs|sdk|cli|commands|configuration|config|glossary)/"),
    ("Design system / style guide", START + r"design[-_]systems?/"),
]
DOCS_SITE = START + r"(docs?|documentation|docs-site|website|site|content|pages|mintlify|gitbooks?|versioned_docs|wiki|book)/"
DOCS_SITE_LABEL, OTHER_LABEL = "Docs site page (general)", "Other (unclassified)"

# Repository name parts that are ordinary words.
GENERIC_WORDS = ["agents", "ai", "cli", "micro", "pi", "sim", "rig", "everywhere"]
VERSION_SEGMENT = r"/v?\d+(?:\.\d+)+(?=/)"

# Signals in documentation.
GUARDRAILS = {
    "Sandboxing": [r"\bsandbox(ed|ing)?\b", r"\bisolated (environment|execution|container)\b", r"\bcontainer(ized)? isolation\b", r"\bvm isolation\b", r"\bchroot\b"],
    "Human_Approval_Gate": [r"human[- ]in[- ]the[- ]loop", r"require(s)? approval", r"confirm before", r"approval required", r"ask (for )?(permission|confirmation) before", r"review before (executing|running|applying)"],
    "Tool_Allow_Deny_List": [r"\ballow[- ]?list(ed|ing)?\b", r"\bdeny[- ]?list(ed|ing)?\b", r"\bwhitelist(ed|ing)?\b", r"\bblacklist(ed|ing)?\b", r"blocked commands", r"permitted (tools|commands|actions)"],
    "Rate_Limiting": [r"\brate[- ]?limit(ed|ing|s)?\b", r"\bthrottl(e|ed|ing)\b", r"\bquota(s)?\b"],
    "Credential_Handling": [r"api key(s)? (are |is )?(stored|encrypted|never sent|kept local)", r"\bkeychain\b", r"\benv(ironment)? variable(s)?\b.{0,30}\bkey\b", r"stored locally", r"encrypted at rest", r"never (leave|leaves) your (device|machine)", r"credentials (stay|remain) (local|on your)"],
    "Prompt_Injection_Awareness": [r"prompt injection", r"jailbreak(ing)?", r"untrusted (content|input|data)", r"malicious instructions", r"injection attack"],
    "Audit_Logging": [r"\baudit log(s|ging)?\b", r"\bactivity log(s|ging)?\b", r"\bexecution log(s|ging)?\b", r"\btrace(ability)?\b.{0,20}\b(action|tool|execution)\b"],
}
POLICIES = {
    "Has_Contact_Channel": [r"[\w.+-]+@[\w-]+\.[\w.-]+", r"report(ing)? a (vulnerability|security issue)", r"responsible disclosure", r"security@"],
    "Has_Response_SLA": [r"respond(s)? within \d+", r"response time", r"\d+\s*(business\s*)?(days|hours)\s*(to respond|response)"],
    "Has_Supported_Versions": [r"supported versions", r"version.{0,15}(support|eol|end of life)"],
    "Has_PGP_Key": [r"pgp", r"gpg key", r"-----BEGIN PGP"],
}
CHANGELOG_NAME = r"^(CHANGELOG|HISTORY|SECURITY|RELEASES?)"
CVE, GHSA = r"CVE-\d{4}-\d{4,7}", r"GHSA-[0-9a-z]{4}-[0-9a-z]{4}-[0-9a-z]{4}"

# Triage of repositories.
AGENT_CORE = r"\bagent(ic)?s?\b"
LOOSE_TERMS = r"\b(assistant|autonomous|automation|copilot|chatbot|orchestrat)\b"
EXCLUDE_TERMS = r"\b(awesome|guide|checklist|tutorial|course|from scratch|curated list|lessons|notebooks|collection|cheatsheet|roadmap|interview|book)\b"
STRONG_TOPICS = ["ai-agent", "ai-agents", "agent", "agents", "llm-agent", "llm-agents", "agentic-ai", "agentic", "autonomous-agents", "autonomous-agent", "multi-agent", "multi-agent-systems", "agent-framework"]
ADJACENT_TOPICS = ["assistant", "ai-assistant", "personal-assistant", "chatbot", "workflow-automation", "automation", "llm", "llm-apps", "mcp", "mcp-server", "mcp-client", "tool-calling", "function-calling"]
BEHAVIOR = r"\b(runs? (tools?|tasks?)|executes? (tasks?|commands?|code)|plans? and (executes?|acts?)|acts? on your behalf|autonomous(ly)?|multi-?step|tool[- ]use|tool calling|function calling|self-correct|self-improv|takes? actions?|connects? models,? tools|build (and )?(deploy )?ai agents?|ai agents and workflows)\b"
SNIPPET_CHARS = 400
