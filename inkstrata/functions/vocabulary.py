"""Vocabularies, patterns and thresholds of the detectors."""

# Terms of the lexical cluster.
LEXICAL = (
    "accordingly", "additionally", "arguably", "certainly", "consequently", "hence", "however", "indeed", "moreover", "nevertheless", "nonetheless", "notwithstanding", "thus", "undoubtedly",
    "adept", "commendable", "ever-evolving", "exciting", "exemplary", "invaluable", "robust", "seamless", "synergistic", "thought-provoking", "transformative", "utmost", "vibrant", "vital", "innovative", "cutting-edge", "game-changing", "pivotal",
    "innovation", "tapestry", "realm", "landscape", "aligns", "augment", "delve", "embark", "facilitate", "leverage", "maximize", "underscores", "utilize", "harness", "illuminate", "revolutionize", "bolster", "streamline",
    "a testament to", "in summary", "in conclusion", "it's important to note", "it's important to consider", "it's worth noting that", "on the contrary", "that being said", "at its core", "to put it simply", "this underscores the importance of", "a key takeaway is", "from a broader perspective", "generally speaking", "broadly speaking",
    "tends to", "to some extent", "shed light on", "sheds light on", "seamless integration", "scalable solution", "actionable insights", "data-driven insights", "data-driven decisions", "leveraging", "this ensures that", "helper function to", "helper to", "this module provides", "this module offers", "we can see that", "under the hood", "out of the box", "at the end of the day", "as mentioned above", "for the sake of", "in order to",
    "a comprehensive", "provides a streamlined", "comprehensive", "ergonomic", "ready for production",
)

# Markers of the file and repository detectors.
TUTORIAL = ("this function", "this module", "helper to", "we can see", "as mentioned", "to", "this ensures", "for")
TUTORIAL_STARTS = ("returns ", "sets ", "initializes ", "gets ")
PRESERVE = ("safety", "invariant", "why", "because", "security", "caveat", "trade-off", "todo", "fixme", "hack", "xxx", "note:")
PROMPT = ("as an ai language model", "i can't assist with", "i cannot help with", "let's break this down", "here's the updated", "assistant:", "user:", "analysis:", "chain of thought", "prompt:")
FOREIGN = ("console.log(", "package main", "fmt.println(", "public static void main", "system.out.println(", "try:\n", "except ", "def __init__", "class ", "self.", "await asyncio", "npm install", "pip install", "golang")
NATIVE = ("result<", "option<", "if let", "match ", "impl ", "#[derive", "thiserror", "anyhow", "?;", "cargo ")
README_HEADINGS = ("installation", "usage", "features", "roadmap", "contributing", "license", "acknowledgements", "faq", "getting started")
README_PHRASES = ("replace this section", "add your project description", "feel free to", "open an issue", "pull requests are welcome", "this project was bootstrapped", "made with", "template")
README_DROPPABLE = ("getting started", "roadmap", "acknowledgements", "faq", "features", "installation")
METADATA_FILES = ("CONTRIBUTING.md", "CODE_OF_CONDUCT.md", "SECURITY.md", "SUPPORT.md", "GOVERNANCE.md")
METADATA_MARKERS = ("all contributors are expected", "by participating in this project", "security policy", "report a vulnerability", "code of conduct", "unless otherwise noted")
WORKFLOW_FILES = (".github/workflows/ci.yml", ".github/workflows/release.yml", ".github/ISSUE_TEMPLATE/bug_report.md", ".github/ISSUE_TEMPLATE/feature_request.md", ".github/PULL_REQUEST_TEMPLATE.md", "CODEOWNERS", "dependabot.yml")
WORKFLOW_MARKERS = ("welcome contributors", "thanks for taking the time", "automatically generated", "please fill out", "lint, test, and release", "continuous integration", "template")
PROMOTION_MARKERS = ("revolutionary", "game-changing", "new", "enterprise-ready", "high-quality", "ready for production", "launching", "viral", "one-click", "instant", "showcase", "demo")
PLACEHOLDERS = ("coming soon", "todo", "tbd", "placeholder", "lorem ipsum", "to be added", "wip", "generated by")
GENERIC_NAMES = ("ai", "assistant", "tool", "project", "app", "generator", "wrapper", "template", "starter", "scaffold", "ultimate", "nextgen", "best", "super")
LAYERS = ("domain", "application", "infrastructure", "presentation", "ports", "adapters", "core", "commands", "queries", "handlers", "services", "repositories", "entities", "aggregates", "value_objects", "events", "use_cases", "interfaces", "cli", "api", "lib", "config", "models", "utils")
RECOVERY = ("wip", "oops", "fixup", "fix:", "fix!: ", "squash", "revert", "undo", "wrong", "mistake", "amend", "whoops", "typo", "missed", "forgot")
CONVENTIONAL_TYPES = ("feat", "fix", "chore", "refactor", "test", "docs", "style", "ci", "build", "perf", "revert")
CODE_EXTENSIONS = ("rs", "go", "py", "ts", "tsx", "js", "cs", "zig")
DOC_EXTENSIONS = ("md", "rst", "txt", "adoc")
CONFIG_EXTENSIONS = ("toml", "yaml", "yml", "json")
IMAGE_EXTENSIONS = ("png", "jpg", "jpeg", "gif", "webp", "svg")
LANGUAGES = {"rust": ("rs",), "python": ("py", "pyw"), "go": ("go",), "typescript": ("ts", "tsx", "mts"), "csharp": ("cs",), "zig": ("zig",), "cpp": ("cpp", "cc", "cxx", "hpp", "hxx")}
SECURITY_EXTENSIONS = ("rs", "go", "zig", "py", "ts", "tsx", "js", "jsx", "cs")
SKIPPED_SECURITY = ("target", "vendor", "node_modules", ".git")
IGNORE_FILE, IGNORE_NEXT = "inkstrata:ignore-file", "inkstrata:ignore-next-line"

# Security rules (id, severity, confidence, extensions or () for all, ignore case, pattern).
SECURITY = (
    ("SEC001", "high", 0.80, ("rs", "go", "ts", "tsx", "cs", "py"), True, r"""(?:format!|fmt\.Sprintf|string\.Format|(?:f"|f'))\s*\(?\s*["']?\s*(?:SELECT|INSERT|UPDATE|DELETE|DROP|EXEC|EXECUTE|CALL)\s[^"'\n]*(?:\{\d*\}|%[sdvf]|\{[a-z_]+\})[^"'\n]*["']?"""),
    ("SEC002", "high", 0.85, ("ts", "tsx", "py", "js"), False, r"\b(?:eval|exec)\s*\(\s*(?:[a-zA-Z_$][a-zA-Z0-9_$]*|`[^`]*\$\{)"),
    ("SEC003", "high", 0.75, (), True, r"""(?:password|passwd|secret|api_key|apikey|auth_token|access_token|private_key|client_secret)\s*(?::=|[:=])\s*["'][^"'\s]{6,}["']"""),
    ("SEC004", "high", 0.85, (), False, r"""\b(?:MD5|SHA1\b|SHA-1|DES\b|3DES|TripleDES|RC4|Blowfish|AES[_-]?ECB|ECB[_-]?mode|new\s+MD5|hashlib\.(?:md5|sha1)\b|MessageDigest\.getInstance\s*\(\s*["']MD5|createHash\s*\(\s*["'](?:md5|sha1)["'])"""),
    ("SEC005", "high", 0.90, ("rs", "go", "ts", "tsx", "cs", "py"), True, r"(?:InsecureSkipVerify|verify\s*=\s*False|verify_ssl\s*=\s*False|checkCertificate\s*=\s*false|ServerCertificateValidationCallback\s*=.*?true|rejectUnauthorized\s*:\s*false|danger.*?disable.*?cert)"),
    ("SEC006", "high", 0.88, ("ts", "tsx", "js", "go", "py", "cs"), True, r"""(?:algorithm\s*[:=]\s*["']none["']|alg\s*[:=]\s*["']none["']|algorithms\s*[:=]\s*\[\s*["']none["']|\.decode\s*\([^)]*verify\s*=\s*False)"""),
    ("SEC007", "high", 0.90, ("ts", "tsx", "js", "jsx"), False, r"dangerouslySetInnerHTML\s*=\s*\{\s*\{?\s*__html\s*:"),
    ("SEC008", "high", 0.75, ("rs", "go", "ts", "tsx", "cs", "py"), False, r"(?:open|read_to_string|File::open|os\.Open|fs\.readFile|File\.Open)\s*\([^)]*(?:req\.|request\.|params\.|query\.|body\.)[a-z_]+[^)]*\)"),
    ("SEC009", "medium", 0.70, (), True, r"(?:log|println|console\.log|fmt\.Print|logging\.|logger\.)\s*[!(]?[^;\n]*(?:password|token|secret|credential|api_key|apikey|private_key)[^;\n]*"),
    ("SEC010", "medium", 0.72, ("py", "ts", "tsx", "cs", "go"), True, r"(?:DEBUG\s*=\s*True|debug\s*:\s*true|app\.run\s*\([^)]*debug\s*=\s*True|\.UseDeveloperExceptionPage\(\)|gin\.SetMode\s*\(\s*gin\.DebugMode)"),
    ("SEC011", "high", 0.78, ("ts", "tsx", "js", "py", "go", "cs"), True, r"(?:token|secret|nonce|salt|otp|session|password)[^;\n]*(?:Math\.random\(\)|random\.random\(\)|rand\.Intn|rand\.Float)|(?:Math\.random\(\)|random\.random\(\)|rand\.Intn|rand\.Float)[^;\n]*(?:token|secret|nonce|salt|otp|session|password)"),
    ("SEC012", "high", 0.85, ("py", "cs", "ts", "tsx"), True, r"(?:pickle\.loads?\s*\(|yaml\.load\s*\(|BinaryFormatter\(\)\.Deserialize|new\s+BinaryFormatter)"),
    ("SEC013", "high", 0.72, ("ts", "tsx", "go", "py", "cs", "rs"), True, r"(?:fetch|axios\.get|http\.Get|requests\.get|HttpClient\s*\.\s*GetAsync|reqwest::get)\s*\([^)]*(?:req\.|request\.|params\.|query\.|body\.)[a-z_]"),
    ("SEC014", "high", 0.82, (), True, r"""(?:iv\s*=\s*b?["'][0-9a-f]{16,32}["']|nonce\s*=\s*b?["'][0-9a-f]{12,32}["']|iv\s*[:=]\s*\[\s*0(?:\s*,\s*0)+\s*\]|nonce\s*[:=]\s*\[\s*0(?:\s*,\s*0)+\s*\])"""),
    ("SEC015", "medium", 0.68, (), True, r"//\s*(?:TODO|FIXME|HACK|XXX)[^\n]*(?:auth|permission|role|token|jwt|validate|verify|check|access|privilege)"),
)

# How functions and documentation lines look, by language.
FUNCTION_PATTERNS = {
    "rust": r"^\s*(?:pub(?:\s*\([^)]*\))?\s+)?(?:async\s+)?fn\s+\w+",
    "python": r"^\s*(?:async\s+)?def\s+\w+",
    "go": r"^\s*func\s+(?:\([^)]*\)\s*)?\w+",
    "typescript": r"^\s*(?:export\s+(?:default\s+)?)?(?:async\s+)?function\s+\w+",
    "csharp": r"^\s*(?:(?:public|private|protected|internal|static|virtual|override|abstract|async|readonly|sealed|extern|new)\s+)+\w[\w<>\[\]]*\s+\w+\s*\(",
    "zig": r"^\s*(?:pub\s+)?fn\s+\w+",
    "cpp": r"^\s*(?:(?:inline|static|virtual|constexpr|consteval|explicit|friend|override)\s+)*[\w:~*&<>\[\] ]+\s+[\w:~]+\s*\(",
}
DOC_PATTERNS = {"rust": r"^\s*//[/!]", "csharp": r"^\s*//[/!]", "python": r"""^\s*(?:"{3}|'{3})""", "go": r"^\s*//", "typescript": r"^\s*/\*\*", "zig": r"^\s*///", "cpp": r"^\s*(?://[/!]|/\*\*)"}
PUBLIC_STARTS = {"rust": "pub", "typescript": "export ", "csharp": "public ", "zig": "pub "}

# Test names (the first group), their wanted beginning, and assertions (contained, or at the start), by language.
TEST_SHAPES = {
    "rust": (r"fn\s+([A-Za-z0-9_]+)", "test_", ("assert_",), ("assert!(", "assert_eq!(")),
    "python": (r"def\s+(test_[A-Za-z0-9_]+)", "", ("assert ", ".assert_", ".assertEqual(", ".assert_called"), ()),
    "go": (r"func\s+(Test[A-Za-z0-9_]+)", "", ("t.Error", "t.Fatal", "t.Fail", "assert.", "require."), ()),
    "typescript": (r"""(?:it|test)\s*\(\s*['"]([A-Za-z0-9_ ]+)['"]""", "", ("expect(", ".toBe(", ".toEqual("), ()),
    "csharp": (r"(?:public\s+)?(?:void|Task)\s+(\w+)\s*\(", "", ("Assert.", "Xunit.Assert", ".Should()."), ()),
    "zig": (r'test\s+"([^"]+)"', "", ("try std.testing.expect", "testing.expect"), ()),
    "cpp": (r"TEST(?:_F|_P)?\s*\(\s*\w+\s*,\s*(\w+)\s*\)", "", ("EXPECT_", "ASSERT_", "CHECK("), ()),
}

# Detector categories by grade category, weights and bands of the grade.
GRADE_OF = {"lexical": "lexical", "comment": "comments", "structure": "structure", "idiom_mismatch": "structure", "prompt_leakage": "structure", "architecture": "architecture", "security": "security", "readme": "metadata", "metadata": "metadata", "promotion": "metadata", "name_credibility": "metadata", "test_pattern": "testing", "workflow": "workflow", "maintenance": "workflow", "commit_pattern": "history"}
GRADE_WEIGHTS = {"lexical": 0.20, "comments": 0.10, "structure": 0.10, "architecture": 0.20, "security": 0.20, "metadata": 0.08, "testing": 0.08, "workflow": 0.04, "history": 0.08}
GRADE_BANDS = ((3, "A+"), (7, "A"), (10, "A-"), (13, "B+"), (17, "B"), (20, "B-"), (23, "C+"), (27, "C"), (30, "C-"), (33, "D+"), (37, "D"), (40, "D-"))
SEVERITIES = ("low", "medium", "high")
