"""Path fragments that place a file in a layer, and file-tag markers."""

# Generic layers, tried in this order after the stack's own.
GENERIC_LAYERS = {
    "api-routes": ["app/api/", "pages/api/", "src/app/api/"],
    "routes": ["routes/", "src/routes/"],
    "components": ["components/", "src/components/"],
    "modules": ["modules/", "src/modules/"],
    "hooks": ["hooks/", "src/hooks/"],
    "services": ["services/", "src/services/"],
    "types": ["types/", "src/types/", "@types/"],
    "config": ["config/", "configs/", "constants/", "src/config/"],
    "stores": ["store/", "stores/", "zustand/"],
    "utils": ["utils/", "lib/", "helpers/", "common/", "shared/"],
    "providers": ["providers/", "contexts/", "src/providers/"],
    "infrastructure": ["Dockerfile", "docker-compose", ".github/", ".gitlab-ci"],
    "tests": ["__tests__/", "test/", "spec/", ".test.", ".spec."],
}

# Layers of one stack, tried first and in this order.
STACK_LAYERS = {
    "java": {
        "controllers": ["controller.java", "/controller/", "/controllers/", "/rest/", "/web/"],
        "services": ["service.java", "/service/", "/services/"],
        "repositories": ["repository.java", "/repository/", "/repositories/", "/dao/"],
        "dto": ["/dto/", "dto.java", "request.java", "response.java", "requestdto.java", "responsedto.java"],
        "entities": ["/entity/", "/entities/", "/model/", "/domain/"],
        "config": ["config.java", "configuration.java", "/config/", "/configuration/"],
        "mappers": ["mapper.java", "/mapper/", "/mappers/", "/converter/"],
        "utils": ["/util/", "/utils/", "/helper/", "/common/"],
        "tests": ["/test/", "test.java", "tests.java", "/it/", "integrationtest"],
    },
    "python": {
        "routes": ["/routes/", "/endpoints/", "/views/", "/routers/"],
        "services": ["/services/", "/service/"],
        "models": ["/models/", "/schemas/", "/entities/"],
        "utils": ["/utils/", "/helpers/", "/common/", "/shared/"],
        "config": ["/config/", "/configs/", "/settings/", "settings.py", "config.py"],
        "tests": ["/tests/", "/test/", "test_", "_test.py", "conftest.py"],
        "middleware": ["/middleware/", "/middlewares/"],
        "agents": ["/agents/", "/tools/", "/prompts/"],
    },
    "go": {
        "cmd": ["/cmd/"],
        "internal": ["/internal/"],
        "pkg": ["/pkg/"],
        "handlers": ["/handler/", "/handlers/"],
        "services": ["/service/", "/services/"],
        "models": ["/model/", "/models/"],
        "middleware": ["/middleware/"],
        "utils": ["/util/", "/utils/", "/pkg/util"],
        "tests": ["_test.go"],
    },
}
DEFAULT_LAYER = "misc"

# Extensions kept per stack; the last entry is for an unknown stack.
STACK_EXTENSIONS = {
    "typescript": [".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs"],
    "python": [".py"],
    "java": [".java", ".kt", ".kts"],
    "go": [".go"],
    "rust": [".rs"],
    "unknown": [".ts", ".tsx", ".py", ".java"],
}

# Directories never walked into.
PRUNED_DIRS = ["node_modules", ".next", "__pycache__", ".git", "dist", "build", ".venv", "venv",
               ".turbo", ".cache", "coverage", ".nyc_output"]
ENV_PRUNED_DIRS = ["node_modules", ".git", "__pycache__", "venv", ".venv", "dist", "build",
                   ".next", ".turbo", "coverage", ".cache", ".nyc_output", "target", ".gradle"]
TEST_PRUNED_DIRS = ["node_modules", ".git", "__pycache__", ".venv", "venv", ".tox",
                    ".mypy_cache", ".pytest_cache", "dist", "build"]

# File tags.  A file longer than MAX_LOC is labelled, and scanned like any other.
MAX_LOC = 10_000
NOMINAL_LOC = 10
TEST_MARKS = ["__tests__/", ".test.", ".spec.", "/test/", "/tests/"]
GENERATED_PATHS = ["generated/", "auto-generated"]
GENERATED_MARKS = ["generated by", "auto-generated", "autogenerated", "do not edit", "@generated"]

# A file that itself defines checks (directory, name and content must all match).
META_DIRS = r"^scripts/(ci|ce|audit|lint|policy)/"
META_NAMES = r"/enforce-[^/]+\.(ts|js|py|mjs)$|/verify-[^/]+\.(ts|js|py|mjs)$|-rule-[^/]+\.(ts|js|py|mjs)$"
META_MARKS = "RULE_PATTERNS|PatternDef|RULE_DEFS"
META_HEAD = 100
META_SKIPPED_RULES = ["R09", "R13", "R14"]

# Paths the rule scan leaves out (substring match, so "test/" also hits "latest/").
SCAN_SKIP = ["node_modules", ".next", "__tests__", ".test.", ".spec.", "test/", "test_", "evaluation/"]
COMMENT_RULES = ["R09", "R07"]
COMMENT_STARTS = ["//", "*", "/*", "#"]

# Triage.
ALWAYS_LAYERS = ["services", "middleware", "auth", "security", "api-routes", "handlers", "routes"]
ENTRY_POINTS = ["main.ts", "main.py", "main.go", "main.rs", "app.ts", "app.py", "server.ts",
                "server.py", "server.go", "index.ts"]
MIN_IMPORTS = 5
SKIP_EXTENSIONS = [".json", ".yaml", ".yml", ".toml", ".css", ".scss", ".less", ".env.example"]
IMPORT_LINE = r"^\s*(?:import\b|from\b|require\(|use\b|include\b|#include\b)"
STRUCTURAL_LINE = (r"^\s*(?:export\s+\{|export\s+\*|export\s+default\s|export\s+type\s|"
                   r"type\s+\w+\s*=|interface\s+\w+|pub\s+type\s|pub\s+use\s)")
STRUCTURAL_SHARE = 0.9

# String and regex literals blanked before a rule is tried again.
LITERALS = r"""'(?:[^'\\\n]|\\.)*'|"(?:[^"\\\n]|\\.)*"|`(?:[^`\\]|\\.)*`|/(?:[^/\\\n]|\\.)+/[gimsuy]*"""
# Fixed value: clearing an element is no injection risk.
SAFE_CLEAR = r"""\.innerHTML\s*=\s*(?:""|''|``)\s*;?\s*$"""
