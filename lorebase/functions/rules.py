"""Word lists, patterns and constants. All of these are fixed values that results must agree with."""

# Category -> patterns, matched without case and by line.
CATEGORY_PATTERNS = {
    "antipattern": [
        r"\bdon't\s+(use|do|try|call|create|add|put)\b",
        r"\bnever\s+(use|do|try|call|create|add|put)\b",
        r"\bavoid\s+(using|doing|calling)\b",
        r"\b(bad|wrong|incorrect)\s+(way|approach|pattern)\b",
        r"\b(anti-?pattern|code smell)\b",
        r"\bdon't\b.*\binstead\b",
        r"\b(deprecated|obsolete|legacy)\b",
        r"\bshould\s+(not|never)\b",
    ],
    "landmine": [
        r"\b(warning|careful|watch out|beware|danger)\b",
        r"\bdon't\s+(forget|miss|skip|ignore)\b",
        r"\b(gotcha|pitfall|trap|landmine|caveat)\b",
        r"\b(easy to|easily)\s+(miss|forget|overlook|break)\b",
        r"\b(silently|quietly)\s+(fail|break|ignore)\b",
        r"\b(subtle|hidden|tricky)\s+(bug|issue|problem)\b",
    ],
    "decision": [
        r"\b(decided|chose|chosen|picked|selected|opted)\b",
        r"\b(decision|choice):\s",
        r"\b(because|reason|rationale|why)\b.*\b(chose|use|picked|decided)\b",
        r"\b(over|instead of|rather than)\b",
        r"\bwe (went with|will use|are using)\b",
        r"\btrade-?off",
    ],
    "convention": [
        r"\b(convention|standard|rule|guideline)\b",
        r"\b(always|never)\s+(use|do|name|put|run)\b",
        r"\b(naming|coding|style)\s+(convention|pattern|standard)\b",
        r"\bwe (always|never)\b",
        r"\bthe (rule|norm|standard|process|workflow) is\b",
        r"\b(consistent|consistency)\b",
        r"\b(first|then|after|before)\s+(you|we|i)\s+(should|need|must)\b",
    ],
    "preference": [
        r"\b(prefer|like|want|favor)\s+(to|using|that)\b",
        r"\b(recommend|suggest|advise|propose)\b",
        r"\bshould (use|consider|try|avoid)\b",
        r"\bbest practice\b",
        r"\b(better|worse) (to|than)\b",
        r"\b(ideal|optimal)ly?\b",
        r"\bmy (style|approach|preference)\b",
    ],
    "lesson": [
        r"\b(learned|realized|discovered|found out)\b",
        r"\b(turns out|it appears|apparently)\b",
        r"\b(insight|takeaway|lesson)\b",
        r"\b(didn't know|now know|now understand)\b",
        r"\bin hindsight\b",
    ],
    "constraint": [
        r"\b(must|cannot|can't|won't|unable)\b",
        r"\b(limitation|restriction|requirement)\b",
        r"\b(blocked by|depends on|requires)\b",
        r"\b(incompatible|unsupported)\b",
        r"\b(only works|doesn't work)\b",
        r"\b(mandatory|required|necessary)\b",
    ],
    "architecture": [
        r"\b(architecture|design|pattern|structure)\b",
        r"\b(component|module|layer|service)\b.*\b(responsible|handles|manages)\b",
        r"\bdata flow\b",
        r"\b(API|endpoint|route)s?\b.*\b(design|structure)\b",
        r"\b(schema|model)s?\b",
    ],
    "context": [
        r"\b(background|context|history)\b",
        r"\b(for reference|fyi|note that)\b",
        r"\b(previously|earlier|before this)\b",
        r"\b(the situation|the state|currently)\b",
        r"\b(at the time|back when)\b",
        r"\b(because|since|therefore|thus|hence)\b",
        r"\bthe reason\b",
    ],
    "bug": [
        r"\b(bug|issue|error|problem|fix|fixed)\b",
        r"\b(workaround|hack)\b",
        r"\b(broke|broken|fails?|failed)\b",
    ],
    "todo": [
        r"\b(TODO|FIXME|HACK|XXX)\b",
        r"\bneed to\b",
        r"\bshould (add|fix|update|implement)\b",
    ],
    "workflow": [
        r"\b(deploy|deployment|release|rollout)\b",
        r"\b(pipeline|workflow|process|procedure)\b",
        r"\b(step\s*\d|first|then|next|finally)\b.*\b(run|execute|do)\b",
        r"\b(ssh|curl|wget)\s+",
        r"\b(staging|production|prod|uat|dev)\b.*\b(server|environment)\b",
        r"\b(script|verify|check)\b.*\b(before|after)\b",
    ],
    "snippet": [
        r"^\[(java|python|bash|json|sql|yaml|xml|go|rust|typescript|javascript)\]",
        r"^```(java|python|bash|json|sql|yaml|xml|go|rust|typescript|javascript)",
    ],
    "command": [
        r"^(git|npm|yarn|pnpm|uv|pip|cargo|go|make|docker|kubectl)\s+\w+$",
        r"^(cd|ls|pwd|mkdir|rm|cp|mv|cat|grep|find|chmod|chown)\s+",
        r"^\./[\w.-]+\.sh\b",
        r"^[\w-]+\s+(--\w+|\-\w)\s*$",
    ],
    "reference": [
        r"https?://\S+",
        r"\b(documentation|docs|readme|guide|tutorial)\b",
        r"\b(see|refer to|check|read)\b.*\b(file|doc|page|link)\b",
        r"\b(version|v)\s*\d+\.\d+",
    ],
    "observation": [
        r"\bfound\s+\d+\b",
        r"\b(noticed|observed|saw|see)\s+(that|the)\b",
        r"\b(there (is|are)|it (is|has))\b",
        r"[✓✗!]\s+",
        r"\b(confirmed|verified|checked)\b",
    ],
}
# On equal scores the earlier category wins.
CATEGORY_PRIORITY = ["antipattern", "landmine", "decision", "convention", "preference", "lesson", "constraint", "architecture", "workflow", "context", "reference", "observation", "todo", "bug", "snippet", "command"]
# How lasting a category is.
SCOPE = {
    "antipattern": "durable",
    "landmine": "durable",
    "convention": "durable",
    "architecture": "durable",
    "decision": "stable",
    "preference": "stable",
    "lesson": "stable",
    "constraint": "stable",
    "workflow": "stable",
    "reference": "stable",
    "context": "transient",
    "bug": "transient",
    "todo": "transient",
    "snippet": "transient",
    "observation": "transient",
    "command": "transient",
}
SCOPE_FACTOR = {"durable": 2.0, "stable": 1.0, "transient": 0.5}
HIGH_VALUE = ["antipattern", "landmine", "constraint"]
NEVER_PROMOTED = ["command", "snippet"]
# Days until a category's usefulness decays by one step; 30 for others.
CATEGORY_TTL = {"constraint": 90.0, "architecture": 60.0, "antipattern": 60.0, "landmine": 60.0, "convention": 45.0, "workflow": 45.0, "decision": 30.0, "preference": 30.0, "lesson": 30.0, "pattern": 30.0, "reference": 30.0, "todo": 14.0, "bug": 14.0, "observation": 14.0, "context": 7.0, "snippet": 7.0, "command": 7.0}
# Fixed values by kind of memory: days to staleness, trust half-life, retention (0: for ever).
STALE_DAYS = {"episodic": 3, "conversation": 7, "pattern": 14, "project": 21, "reference": 30}
TRUST_HALF_LIFE = {"project": 180.0, "pattern": 60.0, "reference": 120.0, "conversation": 30.0, "episodic": 7.0}
RETENTION_DAYS = {"project": 0, "pattern": 180, "reference": 365, "conversation": 90, "episodic": 7}
# What an event of each reason changes in trust.
TRUST_CHANGE = {"used_correctly": 0.05, "explicitly_confirmed": 0.15, "high_similarity_hit": 0.03, "cross_validated": 0.20, "outdated": -0.10, "partially_incorrect": -0.15, "factually_wrong": -0.30, "superseded": -0.05, "low_utility": -0.03, "contradiction_resolved": -0.20}
# Fixed values of the recall modes: (threshold, limit, weights of similarity, recency and access).
MODES = {"precision": (0.8, 3, 0.85, 0.1, 0.05), "balanced": (0.7, 5, 0.7, 0.2, 0.1), "exploratory": (0.5, 10, 0.5, 0.3, 0.2)}
RELATIONS = ["relates_to", "depends_on", "supersedes", "refines", "contradicts", "elaborates", "mentions"]

# Signs of code and of named things; matched with case.
CODE_SIGNS = [r"```", r"def\s+\w+\s*\(", r"class\s+\w+", r"import\s+\w+", r"function\s+\w+", r"\w+\s*=\s*['\"]", r"npm\s+\w+|pip\s+\w+|uv\s+\w+", r"git\s+\w+"]
ENTITY_SIGNS = [r"/[\w/.-]+", r"https?://\S+", r"[A-Z][a-z]+(?:[A-Z][a-z]+)+", r"\b[A-Z]{2,}\b", r"\b\d+\.\d+\.\d+\b", r"@\w+"]

# Signs of secrets, matched without case.
SECRET_SIGNS = [
    r"password\s*[:=]",
    r"passwd\s*[:=]",
    r"secret\s*[:=]",
    r"token\s*[:=]",
    r"api[_-]?key\s*[:=]",
    r"auth[_-]?token\s*[:=]",
    r"private[_-]?key\s*[:=]",
    r"encryption[_-]?key\s*[:=]",
    r"://\w+:\w+@",
    r"mongodb\+srv://.*:.*@",
    r"postgres://.*:.*@",
    r"mysql://.*:.*@",
    r"AKIA[0-9A-Z]{16}",
    r"aws_secret",
    r"gcp_key",
    r"azure_key",
    r"bearer\s+[a-zA-Z0-9\-_\.]+",
    r"[a-zA-Z0-9+/]{40,}={0,2}",
]
# What is replaced, in this order, without case; $1 and $2 are what stays.
REDACTIONS = [
    (r"sk-[A-Za-z0-9]{48,}", "[OPENAI_KEY_REDACTED]"),
    (r"ghp_[A-Za-z0-9]{36,}", "[GITHUB_PAT_REDACTED]"),
    (r"gho_[A-Za-z0-9]{36,}", "[GITHUB_OAUTH_REDACTED]"),
    (r"AKIA[0-9A-Z]{16}", "[AWS_KEY_REDACTED]"),
    (r"((?:password|passwd|secret|token|api[_-]?key|auth[_-]?token|private[_-]?key)\s*[:=]\s*)['\"]?[A-Za-z0-9_\-./+]{8,}['\"]?", "$1[REDACTED]"),
    (r"(://[^:]+:)[^@]+(@)", "$1[REDACTED]$2"),
    (r"(bearer\s+)[A-Za-z0-9\-_.]{20,}", "$1[REDACTED]"),
]

# Intent -> (keywords, preferred categories).
INTENTS = {
    "debugging": (["bug", "fix", "error", "issue", "broken", "fail", "crash", "exception"], ["bug", "antipattern", "landmine", "pattern"]),
    "howto": (["how to", "how do i", "how can i", "how should i", "what is the way"], ["reference", "pattern", "command", "snippet"]),
    "architecture": (["architecture", "design", "structure", "pattern", "layout", "organize"], ["architecture", "project", "decision"]),
    "decision": (["why", "decision", "chose", "choice", "rationale", "reason", "tradeoff"], ["decision", "constraint", "lesson"]),
    "convention": (["rule", "convention", "conventions", "standard", "guideline", "best practice", "style"], ["convention", "constraint", "preference"]),
    "setup": (["setup", "install", "configure", "config", "env", "environment"], ["reference", "command", "project"]),
    "api": (["api", "endpoint", "route", "request", "response", "rest", "graphql"], ["reference", "pattern", "api"]),
    "todo": (["todo", "task", "remaining", "pending", "next", "backlog"], ["todo", "bug"]),
}

# Known technologies.
TECHNOLOGIES = {
    "framework": ["fastapi", "django", "flask", "react", "vue", "angular", "express", "nextjs", "nuxt", "svelte", "rails", "spring", "laravel", "gin", "echo", "fiber", "actix", "axum", "rocket"],
    "database": ["postgresql", "postgres", "mysql", "mongodb", "redis", "sqlite", "dynamodb", "cassandra", "elasticsearch", "neo4j", "supabase", "firestore", "cockroachdb", "mariadb"],
    "tool": ["docker", "kubernetes", "k8s", "terraform", "ansible", "jenkins", "github actions", "gitlab ci", "circleci", "aws", "gcp", "azure", "vercel", "netlify", "heroku", "cloudflare"],
    "language": ["python", "javascript", "typescript", "rust", "go", "java", "kotlin", "swift", "ruby", "php", "c#", "c++", "scala", "elixir"],
}
COMMAND_STARTS = ["npm", "yarn", "pnpm", "uv", "pip", "python", "node", "git", "docker", "make", "cargo", "go"]
SENSITIVE_NAMES = ["password", "passwd", "pwd", "secret", "token", "key", "api_key", "apikey", "auth", "credential", "private", "encryption", "signing", "database_url", "db_url", "connection_string", "dsn", "uri"]
