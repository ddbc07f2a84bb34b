"""Patterns, labels and names of the six commit-attribution rule sets."""

# Rule sets c01 and c02 (three classes).
ACTOR_AI_LOGINS = ["cursor", "copilot", "devin", "claude", "jules", "sweep", "codeium", "qodo", "clawsweeper"]
ACTOR_BOT_LOGINS = [r"\[bot\]$", r"bot$", r"^dependabot", r"^renovate", r"^github-actions", r"^mergify"]
ACTOR_AI_EMAILS = [
    (r"noreply@anthropic\.com", "Anthropic AI Email"),
    (r"noreply@openai\.com", "OpenAI AI Email"),
    (r"copilot", "Copilot Email Keyword"),
    (r"cursor", "Cursor Email Keyword"),
    (r"devin", "Devin Email Keyword"),
    (r"sweep", "Sweep Email Keyword"),
    (r"claude", "Claude Email Keyword"),
    (r"jules", "Jules Email Keyword"),
    (r"codeium", "Codeium Email Keyword"),
    (r"qodo", "Qodo Email Keyword"),
    (r"clawsweeper", "ClawSweeper Email Keyword"),
]
ACTOR_BOT_EMAILS = [
    (r"\[bot\]@users\.noreply\.github\.com", "GitHub Bot User Email"),
    (r"github-actions", "GitHub Actions Email"),
    (r"dependabot", "Dependabot Email"),
    (r"renovate", "Renovate Email"),
]
ACTOR_AI_NAMES = [
    (r"Cursor\s*Agent", "Cursor Agent Name"),
    (r"\bCursor\b", "Cursor Name"),
    (r"GitHub\s*Copilot", "GitHub Copilot Name"),
    (r"\bCopilot\b", "Copilot Name"),
    (r"\bClaude\b", "Claude AI Name"),
    (r"\bJules\b", "Jules AI Name"),
    (r"\bDevin\b", "Devin AI Name"),
    (r"\bSweep\b", "Sweep AI Name"),
    (r"ClawSweeper", "ClawSweeper Name"),
    (r"\bCodeium\b", "Codeium AI Name"),
    (r"\bQodo\b", "Qodo AI Name"),
]
ACTOR_BOT_NAMES = [(r"\[bot\]", "[bot] in Name"), (r"\bBot\b", "Bot in Name")]
ACTOR_AI_TRAILERS = [
    (r"Co-authored-by:.*(?:cursor|copilot|claude|devin|jules|sweep|codeium|qodo)", "Co-authored-by AI Trailer"),
    (r"Generated-by:\s*(?:Cursor|Copilot|Claude|Devin|Jules|Sweep|AI)", "Generated-by AI Trailer"),
    (r"AI-generated", "AI-generated keyword in commit message"),
    (r"AI-assisted", "AI-assisted keyword in commit message"),
    (r"Assisted-by:\s*(?:Cursor|Copilot|Claude|Devin|Jules|AI)", "Assisted-by AI Trailer"),
    (r"Co-authored-by:\s*Claude", "Co-authored-by Claude"),
    (r"Co-authored-by:\s*Cursor", "Co-authored-by Cursor"),
    (r"Co-authored-by:\s*Copilot", "Co-authored-by Copilot"),
    (r"Co-authored-by:\s*Devin", "Co-authored-by Devin"),
]
ACTOR_BOT_TRAILERS = [
    (r"Co-authored-by:.*<.*\[bot\]@users\.noreply\.github\.com>", "Co-authored-by Bot Email Trailer"),
    (r"Co-authored-by:.*\[bot\]", "Co-authored-by Bot Trailer"),
]
MESSAGE_PR_SIGNALS = [
    (r"\[x\]\s*(?:Generated|Assisted)\s+with\s+(?:Claude|Cursor|Copilot|Devin|AI)", "PR Template Checkbox Attribution"),
    (r"PR\s+Attribution:\s*(?:Claude|Cursor|Copilot|Devin)", "PR Body Attribution Header"),
    (r"ai-generated", "PR Label Signature: ai-generated"),
    (r"claude-code", "PR Label Signature: claude-code"),
]
PR_TEXT_AI = [
    (r"\[x\]\s*(?:Generated|Assisted)\s+with\s+(?:Claude|Cursor|Copilot|Devin|AI)", "PR Template Checkbox: AI Generated"),
    (r"\[x\]\s*AI-assisted", "PR Template Checkbox: AI Assisted"),
    (r"ai-generated", "PR Label: ai-generated"),
    (r"claude-code", "PR Label: claude-code"),
    (r"cursor", "PR Label: cursor"),
    (r"copilot", "PR Label: copilot"),
    (r"devin", "PR Label: devin"),
    (r"sweep", "PR Label: sweep"),
    (r"Generated by\s+(?:Claude|Cursor|Copilot|Devin|Sweep)", "PR Body Attribution"),
    (r"AI-assisted", "PR Body AI-assisted Keyword"),
    (r"Co-authored-by:.*(?:Claude|Cursor|Copilot|Devin|Sweep)", "PR Body Co-authored Trailer"),
]
PR_TEXT_BOT = [(r"dependabot", "PR Label/Body Dependabot"), (r"renovate", "PR Label/Body Renovate"), (r"github-actions", "PR Label/Body GitHub Actions")]

# Rule sets c03 to c06 (four classes).
LOOSE_TRAILERS = [
    (r"Co-authored-by:\s*(?:Claude|Cursor|Copilot|GitHub\s*Copilot|Windsurf|Codeium|Qodo)", "Git Trailer: Co-authored-by AI"),
    (r"Co-authored-by:.*<(?:noreply@anthropic\.com|cursoragent@cursor\.com|copilot@github\.com)>", "Git Trailer: AI Provider Email"),
    (r"Generated-by:\s*(?:Claude|Cursor|Copilot|Windsurf|Codeium)", "Git Trailer: Generated-by AI"),
    (r"\bAI-assisted\b(?:\s*\(Claude Code\)|\s*\(Cursor\)|\s*\(Copilot\))?", "Message Disclosure: AI-assisted"),
    (r"\bAI-generated\b", "Message Disclosure: AI-generated"),
]
STRICT_TRAILERS = [
    (r"Co-authored-by:\s*(?:Claude|Cursor|Copilot|GitHub\s*Copilot|Windsurf|Codeium|Qodo)\s*<", "Git Trailer: Co-authored-by AI"),
    (r"Co-authored-by:.*<(?:noreply@anthropic\.com|cursoragent@cursor\.com|copilot@github\.com)>", "Git Trailer: AI Provider Email"),
    (r"Generated-by:\s*(?:Claude|Cursor|Copilot|Windsurf|Codeium)", "Git Trailer: Generated-by AI"),
    (r"AI-assisted\s*\((?:Claude Code|Cursor|Copilot|Windsurf)\)", "Commit Message: Explicit AI Tool Disclosure"),
]
MIXED_TRAILERS = [
    (r"Co-authored-by:\s*(?:Claude|Cursor|Copilot|GitHub\s*Copilot|Windsurf|Codeium|Qodo)\s*<", "Git Trailer: Co-authored-by AI"),
    (r"Co-authored-by:.*<(?:noreply@anthropic\.com|cursoragent@cursor\.com|copilot@github\.com)>", "Git Trailer: AI Provider Email"),
    (r"Generated-by:\s*(?:Claude|Cursor|Copilot|Windsurf|Codeium)", "Git Trailer: Generated-by AI"),
    (r"\bAI-assisted\b(?:\s*\(Claude Code\)|\s*\(Cursor\)|\s*\(Copilot\))?", "Message Disclosure: AI-assisted"),
    (r"\bAI-generated\b", "Message Disclosure: AI-generated"),
]
AUTONOMOUS_V1 = [
    (r"^sweep(?:-ai)?(?:\[bot\])?$", "Autonomous AI Login: Sweep AI"),
    (r"^devin(?:-ai)?(?:-integration)?(?:\[bot\])?$", "Autonomous AI Login: Devin"),
    (r"^clawsweeper$", "Autonomous AI Login: ClawSweeper"),
    (r"steipete\+clawsweeper@gmail\.com", "Autonomous AI Email: ClawSweeper"),
    (r"Co-authored-by:.*<(?:contact@sweep\.dev|devin.*@cognition\.ai)>", "Autonomous AI Trailer"),
    (r"Co-authored-by:\s*(?:Sweep|Devin|ClawSweeper)", "Autonomous AI Trailer: Sweep/Devin"),
]
AUTONOMOUS_ACTORS = [
    (r"^sweep(?:-ai)?(?:\[bot\])?$", "Actor Login: Sweep AI Autonomous Agent"),
    (r"^devin(?:-ai)?(?:-integration)?(?:\[bot\])?$", "Actor Login: Devin Autonomous Agent"),
    (r"^clawsweeper$", "Actor Login: ClawSweeper Autonomous Agent"),
    (r"steipete\+clawsweeper@gmail\.com", "Author Email: ClawSweeper"),
    (r"Co-authored-by:.*<(?:contact@sweep\.dev|devin.*@cognition\.ai)>", "Git Trailer: Autonomous Agent Email (Sweep/Devin)"),
]
AUTONOMOUS_V2 = [
    *AUTONOMOUS_ACTORS,
    (r"Co-authored-by:\s*(?:Sweep|Devin|ClawSweeper)", "Git Trailer: Sweep/Devin Autonomous Agent"),
    (r"Generated by\s+(?:Sweep|Devin)", "Message Disclosure: Autonomous Agent Generator"),
]
AUTONOMOUS_V3 = [
    *AUTONOMOUS_ACTORS,
    (r"Co-authored-by:\s*(?:Sweep|Devin|ClawSweeper)\s*<", "Git Trailer: Sweep/Devin Autonomous Agent"),
    (r"This PR was generated by\s+(?:Sweep|Devin)", "Commit Message: Autonomous Agent Generator Attribution"),
]
AUTONOMOUS_V4 = [
    *AUTONOMOUS_ACTORS,
    (r"Co-authored-by:\s*(?:Sweep|Devin|ClawSweeper)", "Git Trailer: Sweep/Devin Autonomous Agent"),
    (r"This PR was generated by\s+(?:Sweep|Devin)", "Message Disclosure: Autonomous Agent Generator"),
]
DEVOPS_V1 = [
    (r"^dependabot(?:\[bot\])?$", "DevOps Bot: Dependabot"),
    (r"^renovate(?:\[bot\])?$", "DevOps Bot: Renovate"),
    (r"^github-actions(?:\[bot\])?$", "DevOps Bot: GitHub Actions"),
    (r"\[bot\]$", "Generic Bot Login [bot]"),
    (r"bot$", "Generic Bot Login suffix 'bot'"),
]
DEVOPS_V2 = [
    (r"^dependabot(?:\[bot\])?$", "Actor Login: Dependabot"),
    (r"^renovate(?:\[bot\])?$", "Actor Login: Renovate"),
    (r"^github-actions(?:\[bot\])?$", "Actor Login: GitHub Actions"),
    (r"\[bot\]$", "Generic Bot Login [bot]"),
    (r"bot$", "Generic Bot Login suffix 'bot'"),
]
PR_INTERACTIVE_V1 = [
    (r"\[x\]\s*(?:Generated|Assisted)\s+with\s+(?:Claude|Cursor|Copilot|Windsurf|AI)", "PR Checkbox: AI Assisted/Generated"),
    (r"\[x\]\s*AI-assisted", "PR Checkbox: AI-assisted"),
    (r"(?:^|\s)ai-generated(?:$|\s)", "PR Label: ai-generated"),
    (r"(?:^|\s)claude-code(?:$|\s)", "PR Label: claude-code"),
    (r"(?:^|\s)cursor(?:$|\s)", "PR Label: cursor"),
    (r"Generated with\s+(?:Claude Code|Cursor|Copilot)", "PR Body Attribution"),
    (r"Co-authored-by:\s*(?:Claude|Cursor|Copilot)", "PR Body Co-authored-by Trailer"),
]
PR_INTERACTIVE_V2 = [
    (r"\[x\]\s*(?:Generated|Assisted)\s+with\s+(?:Claude|Cursor|Copilot|Windsurf|AI)", "PR Body Checkbox: AI Assisted/Generated"),
    (r"\[x\]\s*AI-assisted", "PR Body Checkbox: AI-assisted"),
    (r"(?:^|\s)ai-generated(?:$|\s)", "PR Label: ai-generated"),
    (r"(?:^|\s)claude-code(?:$|\s)", "PR Label: claude-code"),
    (r"(?:^|\s)cursor(?:$|\s)", "PR Label: cursor"),
    (r"(?:^|\s)copilot(?:$|\s)", "PR Label: copilot"),
    (r"Generated with\s+(?:Claude Code|Cursor|Copilot)", "PR Body Attribution"),
    (r"Co-authored-by:\s*(?:Claude|Cursor|Copilot)", "PR Body Co-authored-by Trailer"),
]
PR_AUTONOMOUS_V1 = [
    (r"(?:^|\s)sweep(?:$|\s)", "PR Label: sweep (autonomous agent)"),
    (r"^sweep(?:-ai)?(?:\[bot\])?$", "PR Author: Sweep AI"),
    (r"^devin(?:-ai)?(?:\[bot\])?$", "PR Author: Devin AI"),
    (r"This PR was generated by\s+(?:Sweep|Devin)", "PR Body: Autonomous Agent Generator"),
]
PR_AUTONOMOUS_V2 = [*PR_AUTONOMOUS_V1, (r"^sweep/", "PR Branch: sweep/* autonomous branch"), (r"^devin/", "PR Branch: devin/* autonomous branch")]
PR_DEVOPS_V1 = [
    (r"^dependabot(?:\[bot\])?$", "PR Author: Dependabot"),
    (r"^renovate(?:\[bot\])?$", "PR Author: Renovate"),
    (r"(?:^|\s)dependencies(?:$|\s)", "PR Label: dependencies"),
]
PR_DEVOPS_V2 = [*PR_DEVOPS_V1, (r"^dependabot/", "PR Branch: dependabot/*"), (r"^renovate/", "PR Branch: renovate/*")]
PR_LABELS = {
    "interactive": ["cursor", "claude-code", "ai-assisted", "ai-generated", "copilot"],
    "autonomous": ["sweep", "devin"],
    "devops": ["dependencies", "automated-pr", "bot"],
}
CHECKBOXES_V3 = [
    (r"\[x\]\s*(?:AI[- ]assisted|Assisted\s+with\s+(?:Claude|Cursor|Copilot|AI))", "PR Checkbox: AI-assisted"),
    (r"\[x\]\s*(?:Generated\s+with\s+(?:Claude|Cursor|Copilot|AI))", "PR Checkbox: AI-generated"),
    (r"\[x\]\s*Co-authored\s+with\s+Claude\s+Code", "PR Checkbox: Claude Code Co-author"),
]
CHECKBOXES_V4 = [
    (r"\[x\]\s*(?:AI[- ]assisted|Assisted\s+with\s+(?:Claude|Cursor|Copilot|AI))", "PR Checkbox: AI-assisted"),
    (r"\[x\]\s*(?:AI[- ]generated|Generated\s+with\s+(?:Claude|Cursor|Copilot|AI))", "PR Checkbox: AI-generated"),
    (r"\[x\]\s*Co-authored\s+with\s+Claude\s+Code", "PR Checkbox: Claude Code Co-author"),
]
WATERMARKS_V3 = [
    (r"Generated\s+with\s+(?:Claude Code|Cursor|GitHub Copilot|Windsurf)", "PR Body: Tool Generation Watermark"),
    (r"Co-authored-by:\s*(?:Claude|Cursor|Copilot)\s*<", "PR Body: Co-authored-by AI Trailer"),
    (r"This PR was generated by\s+(?:\[Sweep\]|Sweep|Devin)", "PR Body: Autonomous Agent Generator"),
]
WATERMARKS_V4 = [
    (r"Generated\s+with\s+(?:Claude Code|Cursor|GitHub Copilot|Windsurf)", "PR Body: Tool Generation Watermark"),
    (r"Co-authored-by:\s*(?:Claude|Cursor|Copilot|claude-flow)\s*<", "PR Body: Co-authored-by AI Trailer"),
    (r"🤖\s*Generated with\s+\[?claude-flow\]?", "PR Body: claude-flow Generator"),
    (r"Claude-Session:\s*https?://claude\.ai/code/session", "PR Body: Claude Code Session Link"),
    (r"This PR was generated by\s+(?:\[Sweep\]|Sweep|Devin)", "PR Body: Autonomous Agent Generator"),
]
PR_AUTHORS = [
    ("autonomous", r"^sweep(?:-ai)?(?:\[bot\])?$", "Sweep AI"),
    ("autonomous", r"^devin(?:-ai)?(?:-integration)?(?:\[bot\])?$", "Devin AI"),
    ("devops", r"^(?:dependabot|renovate)(?:\[bot\])?$", None),
]
PR_BRANCHES = [("autonomous", "sweep/", "sweep/*"), ("autonomous", "sweep-", "sweep/*"), ("autonomous", "devin/", "devin/*"), ("autonomous", "devin-", "devin/*"), ("devops", "dependabot/", "dependabot/*"), ("devops", "renovate/", "renovate/*")]
CLASSES = [("interactive", "INTERACTIVE_AI_COAUTHORED"), ("autonomous", "AUTONOMOUS_AI_AGENT"), ("devops", "DETERMINISTIC_DEVOPS_BOT")]
HUMAN = "PURE_HUMAN"
THREE_CLASSES = ("INTERACTIVE_AI_COAUTHORED", "AUTONOMOUS_BOT", "HUMAN_ONLY")
