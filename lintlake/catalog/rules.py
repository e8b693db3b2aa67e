"""The line-scan rule catalogue.

One :class:`Rule` per pattern.  Patterns are Java regular expressions, the dialect of
Spark's ``rlike``.
"""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Rule:
    rule: str
    severity: str
    category: str
    phase: int
    pattern: str
    description: str
    confidence: str
    reason: str
    removable: bool = False          # the fix is to delete the line
    code_only: bool = False          # must still match once literals are blanked
    not_on_import: bool = False      # import lines do not count
    not_in_layers: tuple = ()        # layers where the rule is off
    not_in_paths: tuple = ()         # glob patterns where the rule is off


# Patterns, severities, phases, descriptions and confidence of every rule.
TYPESCRIPT = [
    Rule("R09", "MEDIUM", "clean-code", 5, r"console\.log\(", "console.log in production code", "medium", "Debug logging left in code (R09-M1)", removable=True),
    Rule("R09", "LOW", "clean-code", 5, r"console\.error\(", "console.error in production code", "low", "Error logging may be intentional (R09-L1)", removable=True, not_in_layers=("api-routes", "routes", "services", "handlers")),
    Rule("R09", "MEDIUM", "clean-code", 5, r"console\.warn\(", "console.warn in production code", "medium", "Debug logging left in code (R09-M1)", removable=True),
    Rule("R14", "MEDIUM", "build", 0, r"eslint-disable", "ESLint rule suppressed with eslint-disable", "high", "Lint suppression detected (R14)", removable=True, code_only=True),
    Rule("R05", "HIGH", "security", 1, r"dangerouslySetInnerHTML", "dangerouslySetInnerHTML without sanitization (XSS risk)", "high", "XSS-prone API usage (R05)"),
    Rule("R05", "HIGH", "security", 1, r"\.innerHTML\s*=", "Direct innerHTML assignment (XSS risk)", "high", "XSS-prone API usage (R05)"),
    Rule("R05", "CRITICAL", "security", 1, r"\beval\(", "eval() usage (code injection risk)", "high", "Code injection vector (R05)"),
    Rule("R07", "HIGH", "typing", 2, r":\s*any\b", "Explicit 'any' type bypasses TypeScript safety", "high", "Unsafe any type usage (R07)"),
    Rule("R07", "HIGH", "typing", 2, r"as\s+any\b", "Type assertion to 'any' bypasses TypeScript safety", "high", "Unsafe any type assertion (R07)", code_only=True),
    Rule("R07", "HIGH", "typing", 2, r"=\s*any\b", "Type alias assigned to 'any' bypasses TypeScript safety", "high", "Unsafe any type alias (R07)"),
    Rule("R07", "HIGH", "typing", 2, r"[<,]\s*any\b", "Generic type parameter 'any' bypasses TypeScript safety", "high", "Unsafe any type in generic (R07)"),
    Rule("R14", "LOW", "build", 0, r"\bTODO\b", "TODO marker in production code", "high", "Incomplete implementation marker (R14)"),
    Rule("R14", "MEDIUM", "build", 0, r"\bFIXME\b", "FIXME marker indicates known bug", "high", "Known bug marker (R14)"),
    Rule("R14", "MEDIUM", "build", 0, r"\bHACK\b", "HACK marker indicates technical debt", "high", "Technical debt marker (R14)"),
    Rule("R12", "HIGH", "data-integrity", 7, r"localhost:\d+", "Hardcoded localhost URL in production code", "high", "Hardcoded localhost URL (R12)"),
    Rule("R05", "CRITICAL", "security", 1, r"NEXT_PUBLIC_.*SECRET", "Secret exposed via NEXT_PUBLIC_ prefix (visible in browser)", "high", "Secret exposed to client bundle (R05)"),
    Rule("R05", "MEDIUM", "security", 1, r"document\.cookie", "Direct cookie manipulation without Secure/SameSite flags", "high", "Unsafe cookie access (R05)"),
    Rule("R09", "MEDIUM", "clean-code", 5, r"throw\s+new\s+Error\(\s*\)", "Empty throw Error() with no message", "medium", "Empty error message in throw (R09-M1)"),
    Rule("R05", "HIGH", "security", 1, r"rejectUnauthorized:\s*false", "TLS certificate validation disabled", "high", "TLS validation disabled (R05)"),
    Rule("R05", "HIGH", "security", 1, r"verify:\s*False", "TLS certificate validation disabled (Python)", "high", "TLS validation disabled (R05)"),
    Rule("R13", "LOW", "clean-code", 5, r"style=\{\{", "Inline style object in JSX creates new object each render", "medium", "Inline style object literal (R13-M1)"),
    Rule("R13", "LOW", "clean-code", 5, r"['\"][0-9]+(?:px|rem|em)['\"]", "Hardcoded CSS unit value should be a design token", "medium", "Hardcoded CSS unit value (R13-M1)"),
    Rule("R13", "MEDIUM", "clean-code", 5, r"setTimeout\([^,]+,\s*\d{2,}", "setTimeout with hardcoded delay value", "medium", "Hardcoded timeout delay (R13-M1)"),
    Rule("R13", "MEDIUM", "clean-code", 5, r"setInterval\([^,]+,\s*\d{2,}", "setInterval with hardcoded interval value", "medium", "Hardcoded interval value (R13-M1)"),
    Rule("R13", "LOW", "clean-code", 5, r"=\{[0-9]{2,}\}", "Numeric literal in JSX prop should be a named constant", "medium", "Magic number in JSX prop (R13-M1)"),
    Rule("R04", "MEDIUM", "performance", 4, r"JSON\.parse\(JSON\.stringify\(", "JSON.parse(JSON.stringify()) deep clone loses types and is slow", "medium", "Lossy deep clone pattern (R04-M1)"),
    Rule("R04", "LOW", "performance", 5, r"new\s+Array\(\d+\)", "new Array(n) creates sparse array; prefer Array.from or fill", "medium", "Sparse array allocation (R04-M1)"),
    Rule("R04", "LOW", "performance", 5, r"\.(?:map|filter|reduce)\([^)]*\.\.\.", "Spread operator inside map/filter/reduce may cause O(n^2) copies", "medium", "Quadratic spread in loop (R04-M1)"),
    Rule("R01", "LOW", "ssot-dry", 5, r"catch\s*\(\w+\)\s*\{\s*throw\s+\w+\s*;?\s*\}", "Catch block that only rethrows is redundant", "high", "Redundant catch-rethrow (R01)"),
    Rule("R01", "LOW", "ssot-dry", 5, r"['\"](?:application/json|Content-Type|Authorization|Bearer )['\"]", "Common string literal that should be a shared constant", "high", "Duplicated string literal (R01)"),
    Rule("R14", "HIGH", "build", 0, r"@ts-ignore", "@ts-ignore suppresses TypeScript error without explanation", "high", "TypeScript error suppression (R14)"),
    Rule("R14", "MEDIUM", "build", 0, r"@ts-expect-error", "@ts-expect-error suppresses TypeScript error", "high", "TypeScript error suppression (R14)"),
    Rule("R14", "CRITICAL", "build", 0, r"@ts-nocheck", "@ts-nocheck disables TypeScript checking for entire file", "high", "Entire-file type check disabled (R14)", code_only=True),
    Rule("R14", "HIGH", "typing", 2, r"as\s+unknown\s+as\b", "Double type assertion (as unknown as) bypasses all type safety", "high", "Double type assertion bypass (R14)"),
    Rule("R14", "MEDIUM", "typing", 2, r"\w+!\.", "Non-null assertion operator (!) bypasses null checking", "high", "Non-null assertion bypass (R14)"),
    Rule("R05", "CRITICAL", "security", 1, r"new\s+Function\(", "new Function() is equivalent to eval (code injection risk)", "high", "Code injection vector (R05)"),
    Rule("R05", "MEDIUM", "security", 1, r"window\.location\.href\s*=", "Direct window.location.href assignment (open redirect risk)", "high", "Open redirect risk (R05)"),
    Rule("R05", "HIGH", "security", 1, r"document\.write\(", "document.write() can enable XSS and breaks streaming rendering", "high", "XSS and rendering risk (R05)"),
    Rule("R07", "HIGH", "typing", 2, r"<any>", "Angle-bracket type assertion to any", "high", "Unsafe any type assertion (R07)"),
    Rule("R12", "MEDIUM", "data-integrity", 7, r"['\"]0['\"]\.repeat\(\s*(40|64)\s*\)", "Placeholder hash literal — 40-zero or 64-zero string used as fake commit/SHA.", "high", "Placeholder hash literal (R12)"),
    Rule("R12", "MEDIUM", "data-integrity", 7, r"['\"`]https?://localhost[:/]", "Hardcoded localhost URL.", "high", "Hardcoded localhost URL (R12)", not_in_paths=("**/*.test.ts", "**/*.test.tsx", "**/test/**", "**/tests/**", "**/__tests__/**", "**/*.spec.ts")),
]

PYTHON = [
    Rule("R09", "MEDIUM", "clean-code", 5, r"console\.log\(|print\(", "print() in production code", "medium", "Debug print left in code (R09-M1)"),
    Rule("R07", "HIGH", "typing", 2, r"\bAny\b", "Any type usage bypasses mypy safety", "high", "Unsafe Any type usage (R07)"),
    Rule("R05", "HIGH", "security", 1, r"except\s*:", "Bare except catches all exceptions including SystemExit", "high", "Bare except catches all exceptions (R05)"),
    Rule("R05", "CRITICAL", "security", 1, r"eval\(", "eval() usage (code injection risk)", "high", "Code injection vector (R05)"),
    Rule("R05", "CRITICAL", "security", 1, r"exec\(", "exec() usage (code injection risk)", "high", "Code injection vector (R05)"),
    Rule("R05", "HIGH", "security", 1, r"shell\s*=\s*True", "subprocess with shell=True (command injection risk)", "high", "Shell injection vector (R05)"),
    Rule("R05", "HIGH", "security", 1, r"verify\s*=\s*False", "TLS certificate validation disabled", "high", "TLS validation disabled (R05)"),
    Rule("R14", "LOW", "build", 0, r"\bTODO\b", "TODO marker in production code", "high", "Incomplete implementation marker (R14)"),
    Rule("R14", "MEDIUM", "build", 0, r"\bFIXME\b", "FIXME marker indicates known bug", "high", "Known bug marker (R14)"),
    Rule("R12", "HIGH", "data-integrity", 7, r"localhost:\d+", "Hardcoded localhost URL", "high", "Hardcoded localhost URL (R12)"),
    Rule("R13", "LOW", "clean-code", 5, r"\b\d{4,}\b", "Numeric literal in function body should be a named constant", "medium", "Hardcoded numeric literal (R13-M1)"),
    Rule("R13", "MEDIUM", "clean-code", 5, r"time\.sleep\(\s*\d+", "time.sleep with hardcoded duration", "medium", "Hardcoded sleep duration (R13-M1)"),
    Rule("R13", "MEDIUM", "clean-code", 7, r"https?://(?!localhost)[^\s\"']+", "Hardcoded URL should be in configuration", "medium", "Hardcoded URL literal (R13-M1)"),
    Rule("R04", "LOW", "performance", 5, r"for\s+\w+\s+in\s+.*:\s*$", "for...append pattern may be a list comprehension candidate", "medium", "Possible list comprehension candidate (R04-M1)"),
    Rule("R04", "LOW", "performance", 5, r"len\(\w+\)\s*==\s*0", "len(x)==0 should be 'not x' for truthiness check", "medium", "Non-idiomatic length check (R04-M1)"),
    Rule("R04", "LOW", "performance", 5, r"len\(\w+\)\s*>\s*0", "len(x)>0 should be just 'x' for truthiness check", "medium", "Non-idiomatic length check (R04-M1)"),
    Rule("R01", "MEDIUM", "ssot-dry", 3, r"isinstance\(\w+,\s*\w+\).*isinstance\(\w+,\s*\w+\)", "Repeated isinstance checks suggest missing polymorphism", "high", "Type-switching instead of polymorphism (R01)"),
    Rule("R14", "MEDIUM", "build", 0, r"#\s*type:\s*ignore", "type: ignore suppresses mypy error", "high", "Type checker suppression (R14)"),
    Rule("R14", "HIGH", "build", 0, r"except\s+\w+.*:\s*\n?\s*pass\b", "pass in except block silently swallows exception", "high", "Silently swallowed exception (R14)"),
    Rule("R14", "MEDIUM", "build", 0, r"#\s*noqa", "noqa suppresses linter warning", "high", "Linter suppression (R14)"),
    Rule("R05", "HIGH", "security", 1, r"os\.system\(", "os.system() executes shell commands (command injection risk)", "high", "Shell command injection vector (R05)"),
    Rule("R05", "CRITICAL", "security", 1, r"pickle\.loads?\(", "pickle.load/loads can execute arbitrary code on deserialization", "high", "Arbitrary code execution via pickle (R05)"),
    Rule("R05", "HIGH", "security", 1, r"yaml\.load\([^)]*$", "yaml.load without explicit Loader allows code execution", "high", "Unsafe YAML deserialization (R05)"),
    Rule("R14", "MEDIUM", "build", 0, r"\bHACK\b", "HACK marker indicates technical debt", "high", "Technical debt marker (R14)"),
    Rule("R14", "MEDIUM", "build", 1, r"except\s+Exception\b", "Broad except Exception may hide unexpected errors", "high", "Overly broad exception handler (R14)"),
    Rule("R05", "HIGH", "security", 1, r"subprocess\.call\(", "subprocess.call is less safe than subprocess.run", "high", "Less safe subprocess API (R05)"),
    Rule("R12", "MEDIUM", "data-integrity", 7, r"['\"]0['\"] \* (40|64)\b|b['\"]0['\"] \* (40|64)\b", "Placeholder hash literal — 40-zero or 64-zero bytes/string used as fake commit/SHA.", "high", "Placeholder hash literal (R12)"),
    Rule("R12", "MEDIUM", "data-integrity", 7, r"['\"]https?://localhost[:/]", "Hardcoded localhost URL.", "high", "Hardcoded localhost URL (R12)", not_in_paths=("**/test_*.py", "**/*_test.py", "**/test/**", "**/tests/**", "**/*_tests.py")),
]

JAVA = [
    Rule("R14", "MEDIUM", "clean-code", 5, r"System\.out\.println\(", "System.out.println in production code", "medium", "Debug println left in code (R09-M1)", removable=True),
    Rule("R14", "MEDIUM", "clean-code", 5, r"System\.err\.println\(", "System.err.println in production code", "low", "Error logging may be intentional (R09-L1)", removable=True),
    Rule("R14", "HIGH", "build", 0, r"catch\s*\([^)]*\)\s*\{\s*\}", "Empty catch block silently swallows exceptions", "high", "Silently swallowed exception (R14)"),
    Rule("R14", "MEDIUM", "build", 0, r"@SuppressWarnings", "@SuppressWarnings annotation hides compiler warnings", "high", "Compiler warning suppression (R14)"),
    Rule("R14", "MEDIUM", "build", 2, r"throws\s+Exception\b", "throws Exception is too broad", "high", "Overly broad exception declaration (R14)"),
    Rule("R01", "MEDIUM", "ssot-dry", 3, r"instanceof\s+\w+.*instanceof\s+\w+.*instanceof\s+\w+", "instanceof chain suggests missing polymorphism", "high", "Type-switching instead of polymorphism (R01)"),
    Rule("R04", "LOW", "performance", 5, r"new\s+ArrayList<>\(\)", "new ArrayList<>() where List.of() may suffice for immutable lists", "medium", "Mutable list where immutable may suffice (R04-M1)"),
    Rule("R07", "MEDIUM", "typing", 2, r"\bList\b[^<]", "Raw type without generics bypasses compile-time type safety", "high", "Raw type without generics (R07)", not_on_import=True),
    Rule("R02", "MEDIUM", "architecture", 3, r"\bpublic\s+(?:int|long|String|boolean|double|float)\s+\w+\s*;", "Public field should be private with accessor methods", "medium", "Public field exposing internal state (R04-M1)"),
    Rule("R14", "LOW", "build", 0, r"\bTODO\b", "TODO marker in production code", "high", "Incomplete implementation marker (R14)"),
    Rule("R14", "MEDIUM", "build", 0, r"\bFIXME\b", "FIXME marker indicates known bug", "high", "Known bug marker (R14)"),
    Rule("R14", "MEDIUM", "build", 0, r"\bHACK\b", "HACK marker indicates technical debt", "high", "Technical debt marker (R14)"),
    Rule("R13", "HIGH", "clean-code", 7, r"https?://[^\s\"']+:\d{2,5}", "Hardcoded URL with port number", "medium", "Hardcoded URL with port (R13-M1)"),
    Rule("R13", "LOW", "clean-code", 5, r"\b\d{6,}\b", "Large magic number in code (6+ digits)", "medium", "Large hardcoded numeric literal (R13-M1)"),
    Rule("R13", "MEDIUM", "clean-code", 5, r"Thread\.sleep\(\s*\d+", "Thread.sleep with hardcoded duration", "medium", "Hardcoded sleep duration (R13-M1)"),
    Rule("R13", "MEDIUM", "clean-code", 7, r"new\s+ServerSocket\(\s*\d+", "Hardcoded port number should be a configuration constant", "medium", "Hardcoded port number (R13-M1)"),
    Rule("R04", "MEDIUM", "performance", 4, r"\+=\s*\"", "String concatenation with += creates O(n^2) copies in a loop", "medium", "Quadratic string concatenation (R04-M1)"),
    Rule("R04", "LOW", "performance", 4, r"new\s+HashMap<>\(\).*\bfor\b", "new HashMap inside loop causes repeated allocation", "medium", "Allocation inside loop (R04-M1)"),
    Rule("R01", "LOW", "ssot-dry", 5, r"catch\s*\(\w+\s+\w+\)\s*\{\s*throw\s+\w+\s*;?\s*\}", "Catch block that only rethrows is redundant", "high", "Redundant catch-rethrow (R01)"),
    Rule("R05", "HIGH", "security", 1, r"Runtime\.getRuntime\(\)\.exec\(", "Runtime.exec() can enable command injection", "high", "Command injection vector (R05)"),
    Rule("R05", "CRITICAL", "security", 1, r"\"\s*\+\s*\w+\s*\+\s*\".*(?:SELECT|INSERT|UPDATE|DELETE|FROM|WHERE)", "SQL string concatenation (SQL injection risk)", "high", "SQL injection vector (R05)"),
    Rule("R05", "MEDIUM", "security", 2, r"@RequestParam\b(?!.*@Valid)", "@RequestParam without validation", "high", "Unvalidated request parameter (R05)"),
    Rule("R14", "HIGH", "build", 0, r"@SuppressWarnings\s*\(\s*\"unchecked\"\s*\)", "@SuppressWarnings(\"unchecked\") hides unsafe generic cast", "high", "Unsafe generic cast suppression (R14)"),
    Rule("R14", "MEDIUM", "clean-code", 5, r"e\.printStackTrace\(\)", "printStackTrace() in production code", "medium", "Debug println left in code (R09-M1)", removable=True),
]

GO = [
    Rule("R14", "MEDIUM", "clean-code", 5, r"fmt\.Println\(", "fmt.Println in production code", "medium", "Debug println left in code (R09-M1)", removable=True),
    Rule("R14", "MEDIUM", "clean-code", 5, r"fmt\.Printf\(", "fmt.Printf in production code", "medium", "Debug printf left in code (R09-M1)", removable=True),
    Rule("R14", "HIGH", "build", 0, r"if\s+err\s*!=\s*nil\s*\{\s*\}", "Empty error check silently swallows errors", "high", "Silently swallowed error (R14)"),
    Rule("R07", "MEDIUM", "typing", 2, r"\binterface\{\}", "interface{} should be 'any' in Go 1.18+", "high", "Outdated interface{} usage (R07)"),
    Rule("R14", "HIGH", "build", 1, r"\bpanic\(", "panic() crashes the entire program", "high", "Program-crashing panic call (R14)"),
    Rule("R14", "LOW", "build", 0, r"\bTODO\b", "TODO marker in production code", "high", "Incomplete implementation marker (R14)"),
    Rule("R14", "MEDIUM", "build", 0, r"\bFIXME\b", "FIXME marker indicates known bug", "high", "Known bug marker (R14)"),
    Rule("R14", "MEDIUM", "build", 0, r"\bHACK\b", "HACK marker indicates technical debt", "high", "Technical debt marker (R14)"),
    Rule("R13", "HIGH", "clean-code", 7, r"https?://[^\s\"'`]+:\d{2,5}", "Hardcoded URL with port number", "medium", "Hardcoded URL with port (R13-M1)"),
    Rule("R14", "HIGH", "build", 0, r"_\s*=\s*err\b", "Silenced error with _ = err", "high", "Explicitly discarded error (R14)"),
    Rule("R14", "MEDIUM", "build", 1, r"\blog\.Fatal", "log.Fatal in library code calls os.Exit(1)", "high", "Fatal exit in library code (R14)"),
    Rule("R13", "LOW", "clean-code", 5, r"\b\d{3,}\b", "Magic number in code", "medium", "Hardcoded numeric literal (R13-M1)"),
    Rule("R04", "LOW", "performance", 5, r"append\(\w+,\s*\w+\)", "append without pre-allocation; consider make([]T, 0, cap)", "medium", "Slice append without pre-allocation (R04-M1)"),
    Rule("R04", "LOW", "performance", 5, r"string\(\[\]byte\(", "string([]byte) conversion in loop copies data each iteration", "medium", "Repeated string/byte conversion (R04-M1)"),
    Rule("R01", "LOW", "ssot-dry", 5, r"errors\.New\(\"[^\"]+\"\)", "Inline error string should be a package-level sentinel variable", "high", "Inline error instead of sentinel (R01)"),
    Rule("R05", "HIGH", "security", 1, r"http\.ListenAndServe\(", "ListenAndServe without TLS serves unencrypted HTTP", "high", "Unencrypted HTTP server (R05)"),
    Rule("R05", "CRITICAL", "security", 1, r"fmt\.Sprintf\(.*(?:SELECT|INSERT|UPDATE|DELETE)", "fmt.Sprintf with SQL keywords suggests SQL injection risk", "high", "SQL injection vector (R05)"),
    Rule("R14", "MEDIUM", "build", 0, r"//nolint", "//nolint suppresses linter warning", "high", "Linter suppression (R14)"),
    Rule("R14", "MEDIUM", "build", 0, r"_\s*=\s*\w+\.\w+\(", "Discarded return value from function call", "high", "Discarded return value (R14)"),
    Rule("R13", "MEDIUM", "clean-code", 5, r"time\.Sleep\(\s*\d+", "time.Sleep with hardcoded duration", "medium", "Hardcoded sleep duration (R13-M1)"),
]

RUST = [
    Rule("R14", "HIGH", "build", 1, r"\.unwrap\(\)", "unwrap() panics on None/Err in production code", "high", "Panic-prone unwrap call (R14)"),
    Rule("R14", "MEDIUM", "build", 1, r"\.expect\(", "expect() panics with a message on None/Err", "high", "Panic-prone expect call (R14)"),
    Rule("R05", "HIGH", "security", 1, r"\bunsafe\b", "unsafe block bypasses Rust's safety guarantees", "high", "Unsafe block bypasses safety (R05)"),
    Rule("R14", "MEDIUM", "clean-code", 5, r"\bprintln!\(", "println! in production code", "medium", "Debug println left in code (R09-M1)", removable=True),
    Rule("R14", "MEDIUM", "clean-code", 5, r"\beprintln!\(", "eprintln! in production code", "low", "Error logging may be intentional (R09-L1)", removable=True),
    Rule("R14", "LOW", "build", 0, r"\bTODO\b", "TODO marker in production code", "high", "Incomplete implementation marker (R14)"),
    Rule("R14", "MEDIUM", "build", 0, r"\bFIXME\b", "FIXME marker indicates known bug", "high", "Known bug marker (R14)"),
    Rule("R14", "MEDIUM", "build", 0, r"\bHACK\b", "HACK marker indicates technical debt", "high", "Technical debt marker (R14)"),
    Rule("R02", "LOW", "architecture", 3, r"\bpub\s+\w+\s*:", "pub struct field may expose internal state", "medium", "Public field exposing internal state (R04-M1)"),
    Rule("R04", "LOW", "performance", 5, r"\.clone\(\)", "clone() where borrowing may suffice", "medium", "Possible unnecessary clone (R04-M1)"),
    Rule("R14", "MEDIUM", "build", 0, r"#\[allow\(", "#[allow(...)] suppresses compiler lint warnings", "high", "Lint suppression (R14)"),
    Rule("R07", "MEDIUM", "typing", 2, r"\bas\s+[a-z]", "'as' type cast may silently truncate or wrap values", "high", "Unsafe type cast (R07)"),
    Rule("R04", "LOW", "performance", 5, r"\.to_string\(\)", "to_string() on &str allocates unnecessarily when borrowing suffices", "medium", "Possible unnecessary allocation (R04-M1)"),
    Rule("R04", "LOW", "performance", 5, r"\.collect::<Vec<", "collect::<Vec> without size hint may cause re-allocations", "medium", "Vec collect without size hint (R04-M1)"),
    Rule("R05", "CRITICAL", "security", 1, r"\btransmute\b", "std::mem::transmute bypasses all type safety", "high", "Unsafe transmute bypasses type system (R05)"),
    Rule("R05", "HIGH", "security", 1, r"unsafe\b(?!.*//\s*SAFETY)", "unsafe block without SAFETY comment", "high", "Undocumented unsafe block (R05)"),
    Rule("R14", "MEDIUM", "build", 0, r"#\[allow\(unused", "#[allow(unused)] hides dead code that should be removed", "high", "Dead code suppression (R14)"),
    Rule("R14", "HIGH", "build", 0, r"\btodo!\(\)", "todo!() macro panics at runtime (incomplete implementation)", "high", "Incomplete implementation stub (R14)"),
    Rule("R14", "HIGH", "build", 0, r"\bunimplemented!\(\)", "unimplemented!() macro panics at runtime", "high", "Unimplemented code stub (R14)"),
]

BY_STACK = {"typescript": TYPESCRIPT, "python": PYTHON, "java": JAVA, "kotlin": JAVA, "go": GO, "rust": RUST}


def house_literal_rules(packages=(), manifests=()):
    """Rules for a house's own literals: package names and manifest file names that should
    come from a shared constant.  The names are the caller's."""
    def quoted(names):
        return "|".join(r"""['"`]""" + n.replace(".", r"\.") + r"""['"`]""" for n in names)

    made = []
    if packages:
        made.append(Rule("R13", "MEDIUM", "ssot-dry", 5, quoted(packages), "Package-name literal should come from a shared constant.", "high", "Package-name literal (R13)"))
    if manifests:
        made.append(Rule("R13", "MEDIUM", "ssot-dry", 5, quoted(manifests), "Manifest filename literal should come from a shared constant.", "high", "Manifest filename literal (R13)"))
    return made


# Rules for prose corpora, used where the scanned files are documents and not code.
PROSE = [
    Rule("R05", "CRITICAL", "security", 1, r'token\s*=\s*"[0-9a-f]{40}"', "Hard-coded secret", "high", "Secret literal (R05)"),
    Rule("R05", "HIGH", "security", 1, r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[a-z]{2,}", "E-mail address in text", "high", "Personal data (R05)"),
    Rule("R12", "HIGH", "data-integrity", 7, r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b", "Literal IP address", "high", "Literal address (R12)"),
    Rule("R01", "MEDIUM", "ssot-dry", 3, r"\+1 \(\d{3}\) 555-\d{4}", "Phone number", "medium", "Personal data (R01)"),
    Rule("R13", "LOW", "clean-code", 5, r"\b\d{4,}\b", "Long numeric literal", "medium", "Numeric literal (R13-M1)"),
    Rule("R11", "REVIEW", "documentation", 10, r"(?i)\blicen[sc]ed?\b", "Licence line", "low", "Licence wording (R11-L1)"),
    Rule("R09", "LOW", "clean-code", 5, r"[#$%&*]{3}", "Junk marks", "medium", "Junk characters (R09-M1)", removable=True),
    Rule("R02", "MEDIUM", "architecture", 4, r"^.{400,}$", "Over-long line", "medium", "Line length (R02-M1)"),
]

# Checks run on a file after a fix, first hits per check and file are kept.
# Each is (stack, rule, pattern, patterns that excuse the line, message).
FIX_CHECKS = [
    ("python", "R07", r"\bAny\b", r"#|import", "'Any' usage"),
    ("python", "R09", r"^# ===", "", "Banner comment"),
    ("python", "R05", r"verify=False", "", "verify=False"),
    ("python", "R05", r"\beval\(|exec\(", r"#", "eval/exec"),
    ("python", "R13", r'[^a-zA-Z_0-9"][0-9]{3,}', r"#|import|line|port|status_code|0x", "Magic number"),
    ("typescript", "R07", r"\bany\b", r"//|import", "'any' type"),
    ("typescript", "R09", r"console\.(log|warn|error|debug)", r"//", "console statement"),
    ("typescript", "R05", r"dangerouslySetInnerHTML", "", "XSS risk"),
    ("typescript", "R05", r"\beval\(", r"//", "eval"),
    ("typescript", "R13", r'[^a-zA-Z_0-9"][0-9]{3,}', r"//|import|port|0x", "Magic number"),
    ("java", "R07", r"Map[^<]", r"//", "Raw Map type"),
    ("java", "R09", r"System\.out\.print", "", "System.out"),
]

# Unfinished-work markers and unsafe-type patterns looked for in changed files.
STUB = (r"(//|/\*|\*|#|--)\s*.*(TODO|FIXME|HACK)|[Nn]ot.[Ii]mplemented|[Cc]oming.[Ss]oon|"
        r'raise NotImplementedError|todo!|unimplemented!|panic\("not implemented')
UNSAFE = {
    "typescript": [r":\s*any([^A-Za-z0-9_]|$)", r"as\s+any([^A-Za-z0-9_]|$)"],
    "python": [r"#\s*type:\s*ignore"],
    "rust": [r"\bunsafe\b"],
    "go": [r"interface\{\}"],
}

# A component file that exports something must return markup somewhere.
COMPONENT_EXPORT = r"export\s+(default\s+)?function|export\s+(default\s+)?const"
COMPONENT_RETURN = r"return\s*\(?\s*<|return\s+<|return\s*\(\s*$"

# Function heads per extension, for the empty-body check.
FUNCTION_HEAD = {
    "ts": r"^(?:\s*(export\s+)?(default\s+)?function\s+\w+|export\s+(default\s+)?const\s+\w+\s*=\s*\()",
    "java": r"^\s*(public|private|protected|internal|override)?\s*(static\s+)?(fun|void|int|String|boolean|long|double|float|def|var|val)\s+\w+\s*\(",
    "py": r"^\s*def\s+\w+\s*\(",
    "rs": r"^\s*(pub\s+)?fn\s+\w+",
    "go": r"^\s*func\s+",
}
HEAD_KIND = {"ts": "ts", "tsx": "ts", "js": "ts", "jsx": "ts", "java": "java", "kt": "java",
             "kts": "java", "scala": "java", "cs": "java", "py": "py", "rs": "rs", "go": "go"}
BODY_HORIZON = 50
BODY_MIN = 3

# Environment-variable references in code.
ENV_REFERENCES = [
    r"process\.env\.([A-Za-z_][A-Za-z0-9_]*)",
    r'os\.environ\["([A-Za-z_][A-Za-z0-9_]*)"\]',
    r"os\.environ\['([A-Za-z_][A-Za-z0-9_]*)'\]",
    r'os\.getenv\("([A-Za-z_][A-Za-z0-9_]*)"',
    r"os\.getenv\('([A-Za-z_][A-Za-z0-9_]*)'",
    r'os\.environ\.get\("([A-Za-z_][A-Za-z0-9_]*)"',
    r"os\.environ\.get\('([A-Za-z_][A-Za-z0-9_]*)'",
]

# Import statements of TypeScript/JavaScript.
IMPORT_FROM = r"""(?:import\s+(?:(?:type\s+)?(?:\{[^}]*\}|\*\s+as\s+\w+|\w+)(?:\s*,\s*(?:\{[^}]*\}|\*\s+as\s+\w+))?\s+from\s+))['"]([^'"]+)['"]"""
IMPORT_BARE = r"""import\s+['"]([^'"]+)['"]"""
IMPORT_REQUIRE = r"""require\(\s*['"]([^'"]+)['"]\s*\)"""
IMPORT_DYNAMIC = r"""import\(\s*['"]([^'"]+)['"]\s*\)"""
IMPORT_REEXPORT = r"""export\s+(?:type\s+)?(?:\{[^}]*\}|\*(?:\s+as\s+\w+)?)\s+from\s+['"]([^'"]+)['"]"""
IMPORT_NAMED = r"""(?:import|export)\s+(?:type\s+)?(?:\w+\s*,\s*)?\{([^}]*)\}\s+from\s+['"]([^'"]+)['"]"""
IMPORT_DEFAULT = r"""import\s+(\w+)\s*(?:,\s*\{[^}]*\})?\s+from\s+['"]([^'"]+)['"]"""
IMPORT_EXTENSIONS = [".ts", ".tsx", ".js", ".jsx"]
