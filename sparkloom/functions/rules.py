"""Patterns, word lists and tables that decide results. Patterns are in the dialect that Java and RE2 share; ``\\b`` is ASCII."""

from __future__ import annotations

# Rewriting rules, applied in order: (pattern, replacement). A pattern beginning with (?i) ignores case.
NORMALIZE_ERROR = [
    (r"(?i)[A-Za-z]:\\[\w\-\\.]+\.(ts|tsx|js|jsx|py|go|rs|java|c|cpp|h|hpp)", "<FILE>"),
    (r"/[\w\-./]+\.(ts|tsx|js|jsx|py|go|rs|java|c|cpp|h|hpp)", "<FILE>"),
    (r"\.\.?/[\w\-./]+\.(ts|tsx|js|jsx|py|go|rs|java|c|cpp|h|hpp)", "<FILE>"),
    (r":\d+:\d+", ":<LINE>"),
    (r"\(\d+,\s*\d+\)", "(<LINE>)"),
    (r"\[\d+,\s*\d+\]", "[<LINE>]"),
    (r"(?i)line\s+\d+", "line <LINE>"),
    (r"(?i)col(?:umn)?\s+\d+", "col <LINE>"),
    (r"'[^']*'", "'<VALUE>'"),
    (r'"[^"]*"', '"<VALUE>"'),
    (r"`[^`]*`", "`<VALUE>`"),
    (r"\d{4}-\d{2}-\d{2}[\sT]\d{2}:\d{2}:\d{2}(\.\d+)?([+-]\d{2}:?\d{2}|Z)?", "<TIMESTAMP>"),
    (r"\d{2}/\d{2}/\d{4}\s+\d{2}:\d{2}:\d{2}", "<TIMESTAMP>"),
    (r"(?i)\b[0-9a-f]{32,}\b", "<HASH>"),
    (r"\b\d{5,}\b", "<ID>"),
    (r"\s+", " "),
]
LOG_GROUPING = [(r"\d+(\.\d+)?", "<N>"), (r"(?i)[a-f0-9]{8,}", "<HASH>"), (r"/[\w\-./]+", "<PATH>"), (r"'[^']*'", "'<STR>'"), (r'"[^"]*"', '"<STR>"')]
LOG_PATTERN = [(r"\d+(\.\d+)?", "<N>"), (r"(?i)[a-f0-9]{8,}", "<HASH>"), (r"(?i)[a-f0-9-]{36}", "<UUID>"), (r"/[\w\-./]+", "<PATH>"), (r"'[^']*'", "'<STR>'"), (r'"[^"]*"', '"<STR>"'), (r"\s+", " ")]
LOG_CLUSTER = [(r"\d+(\.\d+)?", "<N>"), (r"(?i)[a-f0-9]{8,}", "<H>"), (r"(?i)[a-f0-9-]{36}", "<U>"), (r"/[\w\-./]+", "<P>"), (r"'[^']*'", "<S>"), (r'"[^"]*"', "<S>"), (r"\s+", " ")]
LOG_LINE = [
    (r"\d{4}-\d{2}-\d{2}[T\s]\d{2}:\d{2}:\d{2}(?:\.\d+)?", "TIMESTAMP"),
    (r"\[\d{2}:\d{2}:\d{2}\]", "[TIMESTAMP]"),
    (r"\d+\.\d+\.\d+\.\d+", "IP"),
    (r"\d+ms", "Nms"),
    (r"\d+", "N"),
    (r"(?i)[a-f0-9]{8,}", "HASH"),
    (r'"[^"]*"', '"STR"'),
    (r"'[^']*'", "'STR'"),
    (r"\s+", " "),
]
GENERIC_LINE = [(r"\d+", "N"), (r"0x[a-fA-F0-9]+", "HEX"), (r"(?i)[a-f0-9]{8,}", "HASH"), (r"\s+", " ")]
TEMPLATE = [
    (r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?::\d+)?\b", "<IP>"),
    (r"(?i)\b[a-f0-9]{8}-[a-f0-9]{4}-[a-f0-9]{4}-[a-f0-9]{4}-[a-f0-9]{12}\b", "<UUID>"),
    (r"(?i)\b[a-f0-9]{8,64}\b", "<HASH>"),
    (r"\b\d{4}-\d{2}-\d{2}[T\s]\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:Z|[+-]\d{2}:?\d{2})?\b", "<TIMESTAMP>"),
    (r"(?:/[\w\-.]+)+/?", "<PATH>"),
    (r"https?://[^\s]+", "<URL>"),
    (r"\b\d+(?:\.\d+)?\b", "<NUM>"),
    (r""""[^"]*"|'[^']*'""", "<STRING>"),
    (r"\b[\w.+-]+@[\w.-]+\.\w+\b", "<EMAIL>"),
]
COMMAND = [(r"--\w+(?:=\S+)?", ""), (r"\s-\w+", ""), (r"\s+\S+\.(ts|tsx|js|jsx|json|md|css|scss|html|vue|svelte)(?:\s|$)", " "), (r""""[^"]*"|'[^']*'""", ""), (r"\s+\S*/\S+", ""), (r"\s+", " ")]
TSC_MESSAGE = [(r"'[^']+'", "'X'"), (r"\d+", "N"), (r"\s+", " ")]
LINT_MESSAGE = [(r"'[^']+'", "'X'"), (r'"[^"]+"', '"X"'), (r"\d+", "N"), (r"\s+", " ")]
HTTP_PATH = [(r"\?.*", ""), (r"/\d+", "/:id"), (r"(?i)/[a-f0-9-]{36}", "/:uuid"), (r"(?i)/[a-f0-9]{24}", "/:id")]
FIRST_TOKEN = [(r"^\[.*?\]\s*", ""), (r"^[\d\-:T.Z]+\s*", ""), (r"(?i)^(ERROR|WARN|INFO|DEBUG|TRACE|FATAL)\s*[-:.]?\s*", "")]

# Tests: a text matches if any pattern does.
LIKELY_ERROR = [
    r"(?i)\berror\b",
    r"(?i)\bfailed\b",
    r"(?i)\bfailure\b",
    r"(?i)\bexception\b",
    r"(?i)\bcannot\b",
    r"(?i)\bunable\b",
    r"(?i)\binvalid\b",
    r"(?i)\bunexpected\b",
    r"(?i)\bmissing\b",
    r"(?i)\bundefined\b",
    r"(?i)\bnot found\b",
    r"(?i)\bdoes not exist\b",
    r"(?i)\bnot defined\b",
    r"(?i)\btype mismatch\b",
    r"(?i)\bsyntax error\b",
    r"^\s*\^+\s*$",
]
LOG_LEVELS = [("error", r"(?i)\b(ERROR|ERR|FATAL|CRITICAL)\b"), ("warning", r"(?i)\b(WARN(?:ING)?)\b"), ("info", r"(?i)\b(INFO)\b"), ("debug", r"(?i)\b(DEBUG|TRACE|VERBOSE)\b")]
TIMESTAMPS = [
    (r"(\d{4}-\d{2}-\d{2}[T\s]\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:Z|[+-]\d{2}:?\d{2})?)", 1),
    (r"\[(?:\d{4}-\d{2}-\d{2}\s+)?\d{2}:\d{2}:\d{2}(?:\.\d+)?\]", 0),
    (r"([A-Z][a-z]{2}\s+\d{1,2}\s+\d{2}:\d{2}:\d{2})", 1),
    (r"\b(\d{10,13})\b", 1),
    (r"\b(\d{2}:\d{2}:\d{2}(?:\.\d+)?)\b", 1),
]
LOG_TYPES = [
    ("server", 0.1, [r"\b(GET|POST|PUT|DELETE|PATCH|HEAD|OPTIONS)\s+/\S+\s+\d{3}", r"\bHTTP/\d\.\d\b", r"(?i)\b(request|response|endpoint)\b", r"(?i)\bstatus\s*[:=]\s*\d{3}\b"]),
    ("test", 0.05, [r"\b(PASS|FAIL|SKIP|PENDING)\b", r"\b(describe|it|test|expect|assert)\s*\(", r"(?i)\b(jest|mocha|vitest|pytest|unittest)\b", r"(?i)\bTest\s+(Suites?|Cases?)\b", "✓|✕|●"]),
    ("build", 0.05, [r"(?i)\b(webpack|vite|esbuild|rollup|parcel)\b", r"(?i)\b(tsc|typescript|Compiling|Bundling)\b", r"(?i)\b(npm|yarn|pnpm|bun)\s+(run|build|install)\b", r"(?i)\bBuilt?\s+in\s+\d+", r"(?i)\.(js|ts|tsx|jsx|css|scss)\s+\d+(\.\d+)?\s*(KB|MB|bytes)"]),
    ("application", 0.3, [r"(?i)\[\s*(INFO|DEBUG|WARN|ERROR|TRACE|FATAL)\s*\]", r"(?i)\b(INFO|DEBUG|WARN|ERROR)\s*[-:]"]),
]
KEY_EVENT = [
    r"(?i)\b(start(?:ed|ing)?|stop(?:ped|ping)?|shutdown|restart)\b",
    r"(?i)\b(connect(?:ed|ing)?|disconnect(?:ed|ing)?|reconnect)\b",
    r"(?i)\b(initialized?|ready|listening)\b",
    r"(?i)\b(crash(?:ed)?|panic|abort(?:ed)?)\b",
    r"(?i)\b(deploy(?:ed|ing)?|release|version)\b",
    r"(?i)\b(ERROR|FATAL|CRITICAL)\b",
    r"(?i)\bport\s+\d+\b",
    r"(?i)\bserver\b",
]
KEYWORD_BOOST = [
    (0.4, r"\b(error|Error|ERROR|fail|Fail|FAIL|failed|exception|Exception|EXCEPTION|panic|crash|fatal|critical)\b"),
    (0.3, r"\b(must|MUST|should|SHOULD|required|Required|REQUIRED|important|Important|IMPORTANT|note|Note|NOTE|warning|Warning|WARNING|todo|TODO|fixme|FIXME)\b"),
    (0.2, r"```[\s\S]*?```|`[^`]+`"),
    (0.15, r"(?m)^(#{1,6}\s|[-*+]\s|\d+\.\s|>\s)"),
    (0.1, r"\b(function|class|interface|type|const|let|var|async|await|return|import|export|def|fn|struct|impl|pub|private|public|protected)\b"),
    (0.15, r"(?m)\?[\s]*$"),
    (0.1, r"https?://[^\s]+|@\w+|#\w+"),
]
QUESTION = [r"(?i)^(what|how|why|when|where|who|which|can|could|would|should|is|are|do|does)\b", r"\?\s*\z", r"(?i)\b(explain|describe|tell me|help me understand|what is|what are)\b"]
INSTRUCTION = [
    r"(?i)^(create|write|build|implement|add|remove|fix|update|change|modify|generate|make|refactor)\b",
    r"(?i)^(please|can you|could you|would you|I need you to|I want you to)\b",
    r"(?i)\b(write a|create a|build a|implement a|add a|generate a)\b",
]
CODE = [
    r"(?m)^(import|export|const|let|var|function|class|interface|type)\s+",
    r"(?m)^(def|class|import|from|if|for|while|try|except)\s+",
    r"(?m)^(fn|struct|impl|use|mod|pub|let|mut)\s+",
    r"(?m)^(func|package|import|type|struct|interface)\s+",
]
COMMAND_TYPES = [("test", r"\btest\b|vitest|jest|mocha|ava"), ("build", r"\bbuild\b|compile|tsc\b"), ("lint", r"\blint\b|eslint|prettier"), ("typecheck", r"\bcheck\b|type-check"), ("format", r"\bformat\b")]
INTERNAL_FRAME = [
    r"node_modules",
    r"internal/",
    r"<anonymous>",
    r"native code",
    r"\[native code\]",
    r"webpack:",
    r"turbopack:",
    r"at Module\.",
    r"at require \(",
    r"at Object\.<anonymous>",
    r"at processTicksAndRejections",
    r"at async ",
    r"__webpack_require__",
]
PROJECT_FRAME = [r"/(src|app|lib|pages|components|utils|services|hooks|store)/", r"\.(ts|tsx|js|jsx):\d+"]
KEY_POINT = [r"(?i)\b(decided|will use|should|must|important|critical|required|implemented|created|fixed|updated)\b", r"`[^`]+`", r"^\d+\.", r"^[-*]\s", r"\.(ts|js|py|go|rs|tsx|jsx)\b", r"https?://"]
DECISION = [
    r"(?i)(?:decided|will|going to|let's|I'll|we'll|we should)\s+(.{10,150})",
    r"(?i)(?:the approach|the solution|the plan|strategy)\s+(?:is|will be)\s+(.{10,150})",
    r"(?i)(?:we need to|must|should|have to)\s+(.{10,150})",
    r"(?i)(?:done|completed|finished|implemented|created|fixed|updated):\s*(.{10,150})",
]
BLOCKED_PATH = r"(?i)(\.env|\.git/|id_rsa|\.pem|\.key|credentials|secrets?|\.ssh|\.aws|password)"
TSC = r"^(.+?)\((\d+),(\d+)\):\s*(error|warning)\s+(TS\d+):\s*(.+)$"
LINT_ROW = r"^\s*(\d+):(\d+)\s+(error|warning)\s+(.+?)\s{2,}(\S+)\s*$"
LINT_FILE = r"^([^\s].*\.(js|jsx|ts|tsx|mjs|cjs|vue|svelte))$"
HTTP = r"(?i)\b(GET|POST|PUT|DELETE|PATCH|HEAD|OPTIONS)\s+(/\S*)\s+(\d{3})(?:\s+(\d+(?:\.\d+)?)\s*m?s)?"
# Ordered extractors of error lines: (name, pattern, groups of file, line, column, code, message; 0 is the whole line, None is absent).
ERROR_PARTS = [
    ("typescript", TSC, (1, 2, 3, 5, 6)),
    ("eslint", r"(?i)^(.+?):(\d+):(\d+)\s*-?\s*(error|warning|info)\s+([a-z\-@/]+):\s*(.+)$", (1, 2, 3, 5, 6)),
    ("gcc", r"^(.+?):(\d+):(\d+):\s*(error|warning|note):\s*(.+)$", (1, 2, 3, 4, 5)),
    ("python", r'^File "(.+?)", line (\d+)(?:, in .+)?$', (1, 2, None, None, 0)),
    ("python-error", r"^([A-Z][a-zA-Z]+Error):\s*(.+)$", (None, None, None, 1, 2)),
    ("go", r"^(.+?\.go):(\d+):(\d+):\s*(.+)$", (1, 2, 3, None, 4)),
    ("rust", r"^(error|warning)\[(E\d+)\]:\s*(.+)$", (None, None, None, 2, 3)),
    ("rust-location", r"^\s*-->\s*(.+?):(\d+):(\d+)$", (1, 2, 3, None, 0)),
    ("generic-bracket", r"(?i)^\[(ERROR|WARN(?:ING)?|INFO)\]\s*(.+)$", (None, None, None, 1, 2)),
    ("generic-colon", r"(?i)^(ERROR|WARN(?:ING)?|FATAL):\s*(.+)$", (None, None, None, 1, 2)),
]

# Word lists and tables.
STOPWORDS = [
    "a", "an", "the", "and", "or", "but", "in", "on", "at", "to", "for", "of", "with", "by", "from", "as", "is", "was", "are", "were", "been", "be",
    "have", "has", "had", "do", "does", "did", "will", "would", "could", "should", "may", "might", "must", "shall", "can", "need", "dare", "ought",
    "used", "it", "its", "this", "that", "these", "those", "i", "you", "he", "she", "we", "they", "what", "which", "who", "whom", "when", "where",
    "why", "how", "all", "each", "every", "both", "few", "more", "most", "other", "some", "such", "no", "nor", "not", "only", "own", "same", "so",
    "than", "too", "very", "just", "also",
]
HIGH_WORDS = ["error", "exception", "failed", "failure", "crash", "fatal", "critical", "panic", "abort"]
MEDIUM_WORDS = ["warning", "timeout", "retry", "deprecated", "slow", "memory", "leak"]
LEVEL_SCORES = {"error": 1.0, "warning": 0.7, "info": 0.3, "debug": 0.1}
PACKAGE_MANAGERS = ["npm", "bun", "yarn", "pnpm", "npx", "bunx"]
RETRY_COMMANDS = [
    "npm run build", "npm run test", "npm run lint", "npm run check", "bun run build", "bun run test", "bun test", "bun run lint", "yarn build", "yarn test", "yarn lint",
    "pnpm build", "pnpm test", "pnpm lint", "tsc", "eslint", "prettier", "vitest", "jest", "cargo build", "cargo test", "go build", "go test",
]
EXTENSIONS = {
    ".ts": "typescript", ".tsx": "typescript", ".mts": "typescript", ".cts": "typescript", ".js": "javascript", ".jsx": "javascript", ".mjs": "javascript", ".cjs": "javascript",
    ".py": "python", ".pyw": "python", ".pyi": "python", ".go": "go", ".rs": "rust", ".php": "php", ".phtml": "php", ".php3": "php", ".php4": "php", ".php5": "php", ".php7": "php", ".phps": "php",
    ".swift": "swift", ".json": "json", ".yaml": "yaml", ".yml": "yaml",
}
OUTPUT_RATIOS = {"code": (0.3, 1.5, 0.8), "logs": (0.1, 0.3, 0.2), "stacktrace": (0.1, 0.4, 0.25), "config": (0.2, 0.5, 0.3), "generic": (0.3, 1.0, 0.5), "question": (0.5, 2.0, 1.0), "instruction": (0.3, 1.5, 0.6)}
PRICES = {"opus": (15.0, 75.0), "sonnet": (3.0, 15.0), "haiku": (0.8, 4.0)}
CONTEXT_WINDOW = 200_000
# Weights of a segment's importance.
IMPORTANCE = {"tfidf": 0.4, "position": 0.3, "keyword": 0.3}

# Content types of whole texts.
LOG_START = [
    r"^\[\d{4}-\d{2}-\d{2}[T\s]\d{2}:\d{2}:\d{2}",
    r"^\d{4}-\d{2}-\d{2}[T\s]\d{2}:\d{2}:\d{2}",
    r"(?i)^\[\w+\]\s+(INFO|WARN|WARNING|ERROR|DEBUG|TRACE|FATAL)[\s:]",
    r"(?i)^(INFO|WARN|WARNING|ERROR|DEBUG|TRACE|FATAL)[\s:\[]",
    r"(?i)^\d{2}:\d{2}:\d{2}[.,]\d{3}\s+(INFO|WARN|ERROR|DEBUG)",
    r'^time="[^"]+"\s+level=',
    r'^\{"(level|time|timestamp|msg)":',
    r"^\[[A-Z]+\]\s*\d{4}-\d{2}-\d{2}",
    r"^\w{3}\s+\d{1,2}\s+\d{2}:\d{2}:\d{2}",
    r"^<\d+>\w{3}\s+\d{1,2}",
    r"^<\d+>\d",
    r"(?i)\|\s*(INFO|WARN|ERROR|DEBUG|TRACE)\s*\|",
    r"(?i)\s(INFO|WARN|WARNING|ERROR|DEBUG|TRACE|FATAL):\s",
    r"^\S+\s+\S+\[\d+\]:",
]
BUILD_ERROR = [
    r"(?i)error TS\d+:",
    r"(?i)error\[E\d+\]:",
    r"(?i):\d+:\d+:\s*error:",
    r"(?i)\(\d+,\d+\):\s*error",
    r"(?i)npm ERR!",
    r"(?i)ENOENT:|EACCES:|EPERM:",
    r"(?i)Module not found.*Can't resolve",
    r"(?i)SyntaxError:.*unexpected token",
    r"(?i)ModuleNotFoundError: No module named",
    r"(?i)error: aborting due to",
    r"(?i)FAILURE: Build failed",
    r"(?i)BUILD FAILED",
    r"(?i)error CS\d+:",
]
DIFF_MARK = [r"(?m)^diff --git", r"(?m)^@@\s*-\d+,?\d*\s*\+\d+,?\d*\s*@@", r"(?m)^---\s+a/", r"(?m)^\+\+\+\s+b/"]
CONTENT_FLAGS = {
    "has_code": [r"```|\bfunction\b|\bclass\b|\bconst\b|\blet\b|\bvar\b|\bimport\b|\bexport\b|def\s+\w+|func\s+\w+|fn\s+\w+"],
    "has_logs": [r"\[(INFO|DEBUG|WARN|ERROR|FATAL|TRACE)\]|\b(INFO|DEBUG|WARN|ERROR|FATAL)\b:|\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}"],
    "has_errors": [r"(?i)\b(error|exception|failed|failure|stack\s*trace|traceback|panic)\b", r"at\s+\w+\s*\("],
}
SERVER_LINE = [r"(?i)\b(GET|POST|PUT|DELETE|PATCH|HEAD|OPTIONS)\s+(/\S*)\s+(\d{3})"]
TEST_TEXT = [r"\b(PASS|FAIL|SKIP)\b", r"\b(describe|it|test)\s*\(", "✓|✕|○", r"\bTest(?:s|Suites?):", r"(?i)\bpytest\b", r"(?i)\b(jest|vitest|mocha)\b"]
BUILD_TEXT = [
    r"(?i)\b(webpack|vite|esbuild|rollup|parcel|tsc)\b",
    r"(?i)\b(Compiling|Bundling|Building)\b",
    r"\berror\s+TS\d+\b",
    r"(?i)\bModule not found\b",
    r"(?i)\bBuilt?\s+in\b",
    r"(?i)\.(js|ts|tsx|jsx)\s+\d+(\.\d+)?\s*(KB|MB|B)",
]

# What code given for execution may not hold, and what it is warned of.
BLOCKED_CODE = [
    (r"\beval\s*\(", "eval() is not allowed"),
    (r"\bFunction\s*\(", "Function constructor is not allowed"),
    (r"new\s+Function\s*\(", "new Function() is not allowed"),
    (r"\brequire\s*\(", "require() is not allowed"),
    (r"\bimport\s*\(", "dynamic import() is not allowed"),
    (r"import\.meta", "import.meta is not allowed"),
    (r"\bprocess\b", "process is not allowed"),
    (r"\bglobal\b", "global is not allowed"),
    (r"\bglobalThis\b", "globalThis is not allowed"),
    (r"\b__dirname\b", "__dirname is not allowed"),
    (r"\b__filename\b", "__filename is not allowed"),
    (r"\bBuffer\b", "Buffer is not allowed"),
    (r"__proto__", "__proto__ is not allowed"),
    (r"\.constructor\s*\[", "constructor access is not allowed"),
    (r"\.prototype\s*\[", "prototype access is not allowed"),
    (r"\bReflect\b", "Reflect is not allowed"),
    (r"\bProxy\b", "Proxy is not allowed"),
    (r"\bsetTimeout\s*\(", "setTimeout is not allowed (use await)"),
    (r"\bsetInterval\s*\(", "setInterval is not allowed"),
    (r"\bsetImmediate\s*\(", "setImmediate is not allowed"),
    (r"file://", "file:// URLs are not allowed"),
    (r"\.\./\.\./", "path traversal is not allowed"),
]
CODE_WARNINGS = [(r"while\s*\(\s*true\s*\)", "infinite loop detected"), (r"for\s*\(\s*;\s*;\s*\)", "infinite loop detected"), (r"\.repeat\s*\(\s*\d{6,}\s*\)", "large string repeat")]

# Compiler and bundler output.
WEBPACK_HEAD = r"^ERROR in (.+?)(?::(\d+):(\d+))?$"
WEBPACK_DETAIL = r"Module (?:build )?failed.+?:\s*(.+)"
RUST_HEAD = r"^error\[E(\d+)\]: (.+)"
RUST_PLACE = r"^\s+--> (.+?):(\d+):(\d+)"
GO_ERROR = r"^(.+?):(\d+):(\d+):\s*(.+)"
ANY_ERROR = r"(?i)^(?:error)(?:\[([^\]]+)\])?[:\s]+(.+)"
ANY_WARNING = r"(?i)^(?:warning)(?:\[([^\]]+)\])?[:\s]+(.+)"
ANY_PLACE = r"^(?:\s*(?:at|in|-->)\s+)?(.+?):(\d+)(?::(\d+))?"

# Conversations.
ACTION_START = [r"(?i)^(I |I'll |I've |Let me |I'm going to |I will )", r"(?i)^(Created|Updated|Fixed|Implemented|Added|Removed)"]
FILE_NAME = r"[a-zA-Z0-9_\-./]+\.(?:ts|js|tsx|jsx|py|go|rs|json|yaml|md)\b"
FILE_REFERENCE = r"[a-zA-Z0-9_\-./]+\.(?:ts|js|tsx|jsx|py|go|rs|json|yaml|yml|md|css|scss|html)\b"
FILE_ACTIONS = [
    ("created", r"\b(created?|add(?:ed|ing)?|writ(?:e|ing|ten))\b"),
    ("modified", r"\b(modif(?:y|ied|ying)|updat(?:e|ed|ing)|chang(?:e|ed|ing)|edit(?:ed|ing)?)\b"),
    ("deleted", r"\b(delet(?:e|ed|ing)|remov(?:e|ed|ing))\b"),
]
NOT_CALLS = ["if", "for", "while", "switch", "catch", "function", "return", "throw", "new", "typeof", "instanceof"]

# Skeletons of brace languages. The body of a signature is told by SKELETON_BODY, the value of an arrow function by SKELETON_ARROW.
SKELETON_FUNCTION = [r"^(export\s+)?(async\s+)?function\s+\w+", r"^(export\s+)?const\s+\w+\s*=\s*(async\s+)?\([^)]*\)\s*(=>|:)"]
SKELETON_CLASS = [r"^(export\s+)?(abstract\s+)?class\s+\w+"]
SKELETON_KEPT = r"^(import|from|export|type|interface)\s"
SKELETON_BODY = " { ... }"
SKELETON_ARROW = "=> ..."

# What a message that stands for older ones begins with.
CONTEXT_HEADS = {
    "summary": "[Previous conversation summary]\n",
    "points": "[Key points from conversation]\n",
    "fallback": "[Previous conversation context]\n",
    "hybrid": "[Conversation context]\n",
    "hybrid_points": "\n\nKey points:\n",
}

# Levels looked for in a line, in this order, and lines that tell errors and warnings.
LINE_LEVELS = ["TRACE", "DEBUG", "INFO", "WARN", "WARNING", "ERROR", "FATAL"]
ERROR_LINE = r"\b(error|Error|ERROR|fail|Fail|FAIL|fatal|Fatal|FATAL)\b"
WARNING_LINE = r"\b(warn|Warn|WARN|warning|Warning|WARNING)\b"
# Tests of a text's type, in this order: stack traces (an error's head with frames, or a panic), logs by their lines, configuration, code.
TRACE_HEAD = r"(?m)^(\w*Error|Exception|[Pp]anic):"
TRACE_FRAME = r"(?m)^\s+at\s+"
TRACE_OTHER = r"(?m)^Traceback \(most recent call last\):|^thread '.*' panicked at|^panic:"
LOG_MARK = [r"(?i)\[\s*(INFO|DEBUG|WARN|WARNING|ERROR|TRACE|FATAL)\s*\]", r"\d{4}-\d{2}-\d{2}[T\s]\d{2}:\d{2}:\d{2}"]
YAML_LINE = r"^\s*[\w-]+:\s*.+$|^\s*-\s+"
# What is shown of a build's output, logs and errors.
BUILD_HINT = [r"error TS|warning TS|error\[E|error:|npm ERR|ERROR in", r"(?i)\d+:\d+.*error"]

# What a content type is called, its compressor, and the reduction to expect.
CONTENT_TYPES = {
    "logs": ("Application logs", "logs", "70-90%"),
    "stacktrace": ("Stack trace / Error dump", "stacktrace", "50-80%"),
    "config": ("Configuration file (JSON/YAML)", "config", "30-60%"),
    "code": ("Source code", "generic", "20-50%"),
    "generic": ("Generic text content", "generic", "20-50%"),
}

# Lines of test and build output, headers of diffs' definitions, words of failure, and hints by compiler code.
PYTEST_RESULT = r"^\s*(PASSED|FAILED|SKIPPED|ERROR)\s+(.+?::.+?)(?:\s+\[(\d+)%\])?$"
TEST_TOTALS = r"(?i)(\d+)\s*passed?,?\s*(\d+)\s*failed?(?:,?\s*(\d+)\s*skipped?)?.*?in\s*([\d.]+)s"
BUNDLE_SIZE = r"(?i)(\S+\.(?:js|css|mjs))\s+(\d+(?:\.\d+)?)\s*(B|KB|MB|kB)"
BUILD_TOOK = r"(?i)(?:Built?|Done|Compiled?)\s+in\s+(\d+(?:\.\d+)?)\s*(s|ms)"
HUNK_DEFINITION = r"(?m)^[+-]\s*(export\s+)?(function|class|interface|type|const|let|var|def |fn |pub fn|func )"
HUNK_FAILURE = r"(?i)error|exception|fail|throw|panic"
COMPILER_HINTS = {"TS2304": "Check imports and declarations", "TS2305": "Check the module's exports", "TS2307": "Install the module"}
