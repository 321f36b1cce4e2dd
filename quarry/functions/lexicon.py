"""The word lists that query expansion and ranking must agree on."""

# Terms and what they are also called in code.
SYNONYMS: dict[str, tuple[str, ...]] = {
    "function": ("fn", "method", "procedure", "func", "subroutine"),
    "variable": ("var", "let", "const", "binding", "field"),
    "class": ("struct", "type", "interface", "object"),
    "error": ("exception", "failure", "err", "fault"),
    "async": ("asynchronous", "concurrent", "parallel"),
    "callback": ("handler", "listener", "hook", "delegate"),
    "database": ("db", "storage", "persistence", "datastore"),
    "authentication": ("auth", "login", "signin", "authenticate"),
    "authorization": ("authz", "permissions", "access", "acl"),
    "configuration": ("config", "settings", "options", "preferences"),
    "component": ("widget", "element", "view", "control"),
    "request": ("req", "http", "call"),
    "response": ("res", "reply", "result"),
    "create": ("new", "add", "insert", "make"),
    "delete": ("remove", "drop", "destroy", "erase"),
    "update": ("modify", "change", "edit", "patch"),
    "read": ("get", "fetch", "retrieve", "load"),
}

# Acronyms and their long forms.
ACRONYMS: dict[str, str] = {
    "api": "application programming interface",
    "http": "hypertext transfer protocol",
    "json": "javascript object notation",
    "sql": "structured query language",
    "orm": "object relational mapping",
    "crud": "create read update delete",
    "jwt": "json web token",
    "oauth": "open authorization",
    "rest": "representational state transfer",
    "grpc": "remote procedure call",
    "dto": "data transfer object",
    "ui": "user interface",
    "ux": "user experience",
    "cli": "command line interface",
    "sdk": "software development kit",
    "ide": "integrated development environment",
    "ci": "continuous integration",
    "cd": "continuous deployment",
    "tdd": "test driven development",
    "ddd": "domain driven design",
}

# Short forms that the plain query normaliser writes out.
SHORT_FORMS = {"db": "database", "auth": "authentication", "nav": "navigation", "config": "configuration"}

# Per intent, in order of precedence, substrings, whole words and prefixes that name it.
INTENTS: list[tuple[str, tuple[str, ...], tuple[str, ...], tuple[str, ...]]] = [
    ("test", ("test", "spec", "verify"), (), ()),
    ("migration", ("migration", "migrate", "schema change"), (), ()),
    ("schema", ("schema", "model", "db table", "database", "entity"), ("db",), ()),
    ("implementation", ("implementation", "how is", "how does"), (), ("implement",)),
    ("config", ("configuration", "settings", "environment"), ("config", "env"), ()),
    ("error", ("error handling", "exception", "error", "catch", "throw"), (), ()),
    ("api", ("endpoint", "route", "handler"), ("api",), ()),
    ("hook", ("useeffect", "usestate", "usememo", "hook", "lifecycle"), (), ()),
    ("middleware", ("middleware", "interceptor"), (), ()),
    ("definition", ("class", "interface", "struct", "type", "def"), (), ()),
    ("callers", (), (), ("who calls ", "callers of ", "references to ", "usages of ")),
]

# What marks a query as code.
CODE_STRONG = ("()", "{}", "[]", "=>", "->", "::", "fn ", "let ", "const ", "import ", "export ", "async ", "await ", "pub ", "struct ", "impl ", "class ", "def ", "func ")
CODE_WEAK = (".", ";", "=", "<", ">", "(", ")", "{", "}")

# Words that are no names in source text.
CALL_STOP = ("if", "for", "while", "switch", "catch", "function", "return", "new", "await", "match")
NAME_STOP = (*CALL_STOP, "let", "const", "var", "pub", "impl", "trait", "struct", "enum", "mod", "use")

# Kinds that define something.
DEFINITION_KINDS = ("class", "interface", "type_alias", "struct", "enum", "function", "method", "const", "trait", "module")

# Source languages by file extension.
LANGUAGES = {
    "ts": "typescript", "tsx": "typescript", "rs": "rust", "py": "python", "go": "go", "java": "java", "js": "javascript", "jsx": "javascript",
    "c": "c", "h": "c", "cpp": "cpp", "cc": "cpp", "cxx": "cpp", "hpp": "cpp",
}

# How sure an edge of each type is, and how strongly it passes a score on.
EDGE_CONFIDENCE = {"call": 1.0, "extends": 0.95, "implements": 0.95, "alias": 0.9, "type": 0.9, "reference": 0.8, "reads": 0.7, "writes": 0.7}
EDGE_PULL = {"extends": 1.5, "implements": 1.5, "alias": 1.5, "type": 1.5, "call": 1.0, "reference": 0.8}
RESOLUTION_RANK = {"local": 3, "import": 2, "heuristic": 1}
RESOLUTION_PULL = {"local": 1.0, "import": 0.9, "heuristic": 0.75}
