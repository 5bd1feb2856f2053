"""Detection rules: a table of named URL patterns plus fixed lists and thresholds.

The default table is written from public descriptions of each attack; the source
is named above each rule. It is built from a few encodings (blank, quote, dot,
slash ...) and lists of indicators. Every pattern stays inside the dialect shared
by Java and RE2: no look-around, no back-references, no repeated group with
alternatives except blanks. Patterns are searched anywhere in the URL, ignoring
ASCII case.

Analysts extend or replace the table by passing another ``RuleSet``; a table
kept in a file or store is read with ``RuleSet.from_table``.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame

SEVERITIES = ("critical", "high", "medium", "low")

# --- building blocks: one character and its usual encodings -----------------
BLANK = r"(?:[ +]|%20|/\*\*/)"
SQUOTE = r"(?:'|%27)"
QUOTE = r"(?:['\"]|%27|%22)"
LT = r"(?:<|%3c)"
LPAR = r"(?:\(|%28)"
RPAR = r"(?:\)|%29)"
LBRACE = r"(?:\{|%7b)"
LBRACKET = r"(?:\[|%5b)"
DOLLAR = r"(?:\$|%24)"
HASH = r"(?:#|%23)"
PERCENT = r"(?:%|%25)"
DOT = r"(?:\.|%2e|%252e)"
SLASH = r"(?:/|\\|%2f|%5c|%252f|%c0%af|%c1%9c)"
COLON = r"(?::|%3a)"
NEWLINE = r"(?:%0d|%0a|%250d|%250a)"


def _any(words: str) -> str:
    """Alternation over blank-separated literal words."""
    return "(?:" + "|".join(re.escape(w) for w in words.split()) + ")"


def _words(prefix: str, words: str) -> list[str]:
    return [prefix + re.escape(w) for w in words.split()]


def _groups(patterns: Iterable[str]) -> dict[str, list[str]]:
    """First literal of each pattern to the remainders that follow it."""
    groups: dict[str, list[str]] = {}
    for pattern in patterns:
        head = pattern[:2] if pattern[0] == "\\" else pattern[0]
        groups.setdefault(head, []).append(pattern[len(head):])
    return groups


def by_first(patterns: Iterable[str]) -> str:
    """One alternation, grouped by first literal, so that a search position
    whose character starts no pattern is left after a few comparisons."""
    return "|".join(f"{head}(?:{'|'.join(rest)})" for head, rest in _groups(patterns).items())


def _by_second(rest: list[str]) -> str:
    """Group remainders once more where they go on with a plain character."""
    plain = [r for r in rest if re.match(r"(?:[a-z0-9/_]|\\[.\-])(?![*+?{])", r, re.I)]
    other = [r for r in rest if r not in plain]
    return "|".join(([by_first(plain)] if plain else []) + other)


def by_first_class(patterns: Iterable[str], size: int = 8) -> str:
    """As ``by_first``, grouped by two characters and with a character-class
    test before every few groups. Uses a look-ahead, so for Spark only."""
    groups = sorted(_groups(patterns).items())
    chunks = [groups[i:i + size] for i in range(0, len(groups), size)]
    return "|".join(
        f"(?=[{''.join(h for h, _ in c)}])(?:{'|'.join(f'{h}(?:{_by_second(r)})' for h, r in c)})"
        for c in chunks)


# Characters and sequences that make a URL worth the full rule table: all but
# letters, digits, blank, / . _ ? & = , ~ + - and an encoded blank or comma.
UNUSUAL = r"[^A-Za-z0-9 /._?&=,~+%\-]|%(?:[^2]|2[^0c]|2?$)"


@dataclass(frozen=True)
class Rule:
    name: str
    severity: str
    pattern: str
    description: str
    # Patterns covering every match in a URL without anything UNUSUAL.
    # None means "not known": then the rule is tried on every URL.
    words: tuple[str, ...] | None = None

    def __post_init__(self):
        if self.severity not in SEVERITIES:
            raise ValueError(f"rule {self.name}: unknown severity {self.severity}")


def _rule(name, severity, description, words=(), marks=(), covered=None):
    """``words`` can occur in an ordinary URL, ``marks`` need something UNUSUAL.

    ``covered`` maps patterns that begin with a choice to words which every ordinary match of them holds.
    """
    covered = covered or {}
    parts = ([by_first(words)] if words else []) + list(covered) + list(marks)
    return Rule(name, severity, f"(?:{'|'.join(parts)})", description, (*words, *covered.values()))


@dataclass(frozen=True)
class RuleSet:
    """An ordered rule table and the tag sets that decide the attack phase."""

    rules: tuple[Rule, ...]
    exploit_tags: frozenset[str]
    postexploit_tags: frozenset[str]
    recon_tags: frozenset[str]

    def __post_init__(self):
        names = [r.name for r in self.rules]
        if len(names) != len(set(names)):
            raise ValueError("rule names must be unique")

    @property
    def names(self) -> list[str]:
        return [r.name for r in self.rules]

    @property
    def suspect(self) -> str | None:
        """A cheap pattern every URL with a hit also matches, or None."""
        if any(r.words is None for r in self.rules):
            return None
        words = sorted({w for r in self.rules for w in r.words})
        return f"{UNUSUAL}|{by_first_class(words)}" if words else UNUSUAL

    @classmethod
    def from_rows(cls, rows: Iterable, phases: RuleSet | None = None) -> RuleSet:
        """Build from (name, severity, pattern, description) rows."""
        base = phases or DEFAULT_RULES
        rules = tuple(Rule(r[0], r[1], r[2], r[3]) for r in rows)
        return cls(rules, base.exploit_tags, base.postexploit_tags, base.recon_tags)

    @classmethod
    def from_table(cls, table: DataFrame, limit: int = 1000) -> RuleSet:
        """Read a rule table; patterns become part of the plan, so it is bounded."""
        rows = table.select("name", "severity", "pattern", "description").take(limit + 1)
        if len(rows) > limit:
            raise ValueError(f"more than {limit} rules")
        return cls.from_rows(rows)


_EQUALS = r"(?:=|%3d)"
_EQUATION = f"{BLANK}+[0-9]{{1,9}}{BLANK}*="
_COMMANDS = _any("awk base64 bash busybox cat certutil chmod curl cmd dig echo env ftp head hostname id ifconfig "
                 "ipconfig ksh ls nc ncat netcat netstat nslookup perl php ping powershell ps pwd pwsh python "
                 "python3 rm ruby sh sleep socat systeminfo tail tasklist telnet tftp touch uname wget whoami zsh")
_LONE_COMMANDS = _any("hostname id ifconfig ipconfig ls netstat pwd systeminfo tasklist uname whoami")
_COLON2 = f"{COLON}{COLON}"
_SCHEME_END = f"{COLON}(?:/|%2f)(?:/|%2f)"
_INNER = r"(?:localhost|127\.|10\.|192\.168\.|172\.(?:1[6-9]|2[0-9]|3[01])\.|0\.0\.0\.0|0x7f|2130706433|\[|%5b)"
_MONGO = _any("ne eq gt gte lt lte in nin regex exists where or and not nor elemMatch expr function jsonSchema")


def _param(names: str, value: str) -> list[str]:
    """A query parameter of one of the names with a value, first or later in the query."""
    return [rf"\?(?:{names})={value}", rf"&(?:{names})={value}"]


_LANDING = ("redirect|redirect_to|redirect_ur[il]|redirectur[il]|return|return_to|return_ur[il]|returnur[il]|"
            "next|continue|goto|dest|destination|target|forward|back|success_url|cancel_url|logout")
_HANDLERS = _any("onerror onload onclick onmouseover onfocus onblur ontoggle onanimationend onpointerenter onbegin "
                 "onsubmit oninput onchange onkeydown onkeyup onwheel ondrag")

# Written from public descriptions of each attack, named above the rule.
_RULES = (
    # OWASP testing guide INPV-05; function names from the manuals of MySQL, PostgreSQL, SQL Server, Oracle
    _rule("sqli", "high", "SQL injection attempt",
          words=[f"union{BLANK}+select\\b", f"union{BLANK}+(?:all|distinct){BLANK}+select\\b",
                 "information_schema", "pg_catalog", "sqlite_master", "sysobjects", "all_tab_columns",
                 "pg_sleep", f"waitfor{BLANK}+delay", r"dbms_pipe\.receive", r"utl_http\.request", "xp_cmdshell",
                 "sp_oacreate", "sp_executesql", f"into{BLANK}+(?:outfile|dumpfile)\\b",
                 f"order{BLANK}+by{BLANK}+[0-9]{{1,4}}{BLANK}*--"],
          covered={f"{BLANK}(?:or|xor){_EQUATION}": f"r{_EQUATION}", f"{BLANK}and{_EQUATION}": f"and{_EQUATION}",
                   f"{BLANK}having{_EQUATION}": f"having{_EQUATION}"},
          marks=[f"{QUOTE}{RPAR}?{BLANK}*(?:or|and|xor|\\|\\||%7c%7c){BLANK}*{QUOTE}?[a-z0-9_]{{1,30}}{QUOTE}?"
                 f"{BLANK}*(?:=|%3d|<|>|%3c|%3e|like{BLANK}|in{BLANK}*{LPAR})",
                 f"{QUOTE}{BLANK}*(?:--|#|%23|/\\*)", f"{QUOTE}{BLANK}*union{BLANK}",
                 f"(?:;|%3b){BLANK}*(?:drop{BLANK}+table|insert{BLANK}+into|delete{BLANK}+from|declare{BLANK}+(?:@|%40)"
                 f"|exec{BLANK}|shutdown)",
                 f"\\b(?:sleep|benchmark){LPAR}[0-9]", f"\\b(?:load_file|extractvalue|updatexml){LPAR}",
                 f"\\bconcat{LPAR}0x[0-9a-f]{{2}}", f"\\bchar{LPAR}[0-9]{{2,3}}", "/\\*![0-9]{5}"]),
    # MongoDB manual, query operators
    _rule("nosqli", "high", "NoSQL operator injection",
          marks=[f"{LBRACKET}{DOLLAR}{_MONGO}\\b", f"{LBRACE}{BLANK}*{QUOTE}?{DOLLAR}{_MONGO}\\b",
                 f"{QUOTE}{DOLLAR}{_MONGO}{QUOTE}", f"{DOLLAR}where\\b"]),
    # CWE-78; a command counts when it has an argument, stands alone at the end, or is substituted
    _rule("command_injection", "critical", "Operating-system command injection",
          words=[f"&&{_COMMANDS}{BLANK}", r"/bin/(?:ba|z|k|da|c)?sh\b", "/dev/(?:tcp|udp)/", r"cmd\.exe\b",
                 r"powershell\.exe\b"],
          marks=[f"(?:;|\\||%3b|%7c|%26%26|{NEWLINE}){BLANK}*{_COMMANDS}(?:{BLANK}|%09|{DOLLAR}{LBRACE}?ifs\\b)",
                 f"(?:;|%3b|\\|\\||%7c%7c|%26%26|{NEWLINE}){BLANK}*{_LONE_COMMANDS}(?:[;&|#]|%3b|%7c|%23|%26|{QUOTE}|$)",
                 "(?:`|%60)[a-z/.][^`%&]{0,200}(?:`|%60)", f"{DOLLAR}{LPAR}[^)&(]{{1,200}}{RPAR}",
                 f"{DOLLAR}{LBRACE}?ifs\\b", "(?:%5c|\\\\)(?:cmd|powershell)\\b"]),
    # CVE-2014-6271
    _rule("shellshock", "critical", "Function definition in an environment value",
          marks=[f"{LPAR}{BLANK}?{RPAR}{BLANK}*{LBRACE}"]),
    # CWE-1336; Jinja, FreeMarker, ERB and expression-language syntax
    _rule("ssti", "high", "Template expression injection",
          words=["__class__", "__mro__", "__subclasses__", "__globals__", "__builtins__", r"freemarker\.template",
                 r"java\.lang\.(?:runtime|processbuilder)"],
          marks=[f"{LBRACE}{LBRACE}[^{{}}]{{1,120}}(?:\\}}|%7d)", f"[$#*@]{LBRACE}[^{{}}]{{1,120}}(?:\\}}|%7d)",
                 f"(?:%24|%23){LBRACE}[^{{}}]{{1,120}}(?:\\}}|%7d)", f"{LBRACE}(?:%25|%(?:[^0-9a-f]|$))",
                 f"{LT}(?:%|%25)(?:=|%3d)"]),
    # RFC 4515 filters, CWE-90
    _rule("ldap_injection", "high", "LDAP filter break-out",
          marks=[f"(?:\\*|%2a){RPAR}{LPAR}", f"{RPAR}{LPAR}(?:[|&!]|%7c|%26|%21)",
                 f"{RPAR}{LPAR}(?:uid|cn|sn|ou|mail|member|memberof|objectclass|userpassword|samaccountname)(?:=|%3d)",
                 f"{LPAR}(?:[|&]|%7c|%26){LPAR}"]),
    # XPath 1.0: axes and core functions, CWE-643
    _rule("xpath_injection", "medium", "XPath expression injection",
          marks=[f"(?:ancestor|descendant|parent|child|following|preceding|self|sibling|attribute){_COLON2}",
                 f"\\b(?:local-name|string-length|normalize-space|starts-with|name|count|position){LPAR}(?:/|%2f|\\.|@|{RPAR})",
                 "(?:\\]|%5d)(?:\\||%7c)(?:/|%2f)", f"{QUOTE}{BLANK}*(?:or|and){BLANK}*{QUOTE}1{QUOTE}(?:=|%3d){QUOTE}1"]),
    # CWE-79; elements and handlers of the HTML standard
    _rule("xss", "medium", "Cross-site scripting attempt",
          words=[r"document\.(?:cookie|domain|write|location)", r"string\.fromcharcode"],
          covered={f"(?:{BLANK}|/){_HANDLERS}{BLANK}*=": f"on[a-z]{{4,15}}{BLANK}*="},
          marks=[f"{LT}{BLANK}*(?:/|%2f)?(?:script|svg|img|iframe|object|embed|body|video|audio|math|details|marquee|"
                 "link|meta|base|form|input|style)\\b",
                 f"(?:{QUOTE}|%09|%0a|%2f){BLANK}*{_HANDLERS}{BLANK}*(?:=|%3d)", f"{BLANK}{_HANDLERS}%3d",
                 f"(?:java|vb)script{COLON}", f"data{COLON}text(?:/|%2f)html",
                 f"\\b(?:alert|confirm|prompt|eval){LPAR}"]),
    # CWE-22, CWE-98; PHP manual, supported wrappers
    _rule("lfi_traversal", "high", "Path traversal or local file inclusion",
          words=[r"/etc/(?:passwd|shadow|group|hosts|issue|sudoers|crontab)\b", "/proc/(?:self|version|cpuinfo|[0-9])",
                 r"boot\.ini\b", r"/win\.ini\b", "/windows/system32", "/var/log/"],
          covered={f"{DOT}{DOT}{SLASH}": r"\.\./"},
          marks=["etc(?:%2f|%252f|%5c|\\\\)(?:passwd|shadow|group|hosts)", "(?:\\\\|%5c|%2f)win\\.ini",
                 f"\\b(?:php|phar|zip|zlib|expect|glob){_SCHEME_END}", "%c0%ae"]),
    # CWE-98
    _rule("rfi", "high", "Remote URL given as a parameter value",
          marks=[f"{_EQUALS}(?:https?|ftps?|smb|php|expect){_SCHEME_END}", f"{_EQUALS}data{COLON}[a-z]{{1,20}}/[a-z]{{1,20}};base64"]),
    # CWE-918; metadata addresses from the documentation of the cloud providers
    _rule("ssrf", "high", "Server-side request to an internal or metadata address",
          words=[r"169\.254\.169\.254", r"169\.254\.170\.2\b", r"168\.63\.129\.16", r"100\.100\.100\.200",
                 r"metadata\.google\.internal", r"burpcollaborator\.net", r"oastify\.com", r"interact\.sh\b",
                 r"oast\.(?:fun|live|me|online|pro|site)\b", r"dnslog\.cn", r"webhook\.site", r"localtest\.me", r"nip\.io\b"],
          marks=[f"{_EQUALS}https?{_SCHEME_END}(?:[a-z0-9._-]{{1,40}}(?:@|%40))?{_INNER}", f"fd00{COLON}ec2",
                 f"{_EQUALS}(?:gopher|dict|ldaps?|tftp|sftp|file|jar|netdoc){COLON}"]),
    # CWE-611; XML 1.0, prolog and declarations
    _rule("xxe", "high", "XML external entity declaration",
          words=["xinclude"],
          marks=[f"{LT}(?:!|%21)(?:doctype|entity|element|attlist)\\b", f"{LT}(?:\\?|%3f)xml\\b",
                 f"{BLANK}(?:system|public){BLANK}+{QUOTE}"]),
    # CWE-502; stream headers of Java, PHP, .NET, Python and Node serialisers
    _rule("deserialization", "high", "Serialised object or code-loading marker",
          words=["=ro0ab", "aced0005", "aaeaaad/////", "=gasv"],
          marks=["%3dro0ab", "aaeaaad%2f%2f", f"\\b[oc]{COLON}[0-9]{{1,6}}{COLON}{QUOTE}",
                 f"\\ba{COLON}[0-9]{{1,6}}{COLON}{LBRACE}", f"_{DOLLAR}{DOLLAR}nd_func", f"{QUOTE}{DOLLAR}type{QUOTE}",
                 "(?:!|%21)(?:!|%21)(?:python|javax|ruby)", "c(?:os|posix|__builtin__)%0a"]),
    # Names of published web shells; a command parameter must hold a command
    _rule("webshell", "critical", "Web shell file or command parameter",
          words=[r"/(?:c99|r57|b374k|wso[0-9.]{0,6}|alfa|alfashell|p0wny|p0wny-shell|weevely|indoxploit|webshell|"
                 r"shell|cmd|backdoor)\.(?:php[3-8]?|phtml|aspx?|ashx|jspx?|cfm)\b",
                 *_param("cmd|command|exec|execute|shell", f"{_COMMANDS}(?:{BLANK}|&|$)")],
          marks=[*_param("cmd|command|exec|execute|shell", f"{_COMMANDS}(?:;|%3b|%7c|\\||{QUOTE})")]),
    # CVE-2021-44228; lookups of the Log4j manual
    _rule("log4shell", "critical", "JNDI lookup in a logged value",
          marks=[f"{DOLLAR}{LBRACE}{BLANK}*jndi\\b", f"\\bjndi{COLON}(?:ldaps?|rmi|dns|iiop|corba|nis|nds|https?)\\b",
                 f"{DOLLAR}{LBRACE}(?:lower|upper|env|sys|date|main|java|base64|ctx|map|bundle|docker|k8s|web){COLON}",
                 f"{DOLLAR}{LBRACE}{_COLON2}-"]),
    # CVE-2022-22965, CVE-2022-22963, CVE-2022-22947
    _rule("spring4shell", "critical", "Class-loader property manipulation",
          words=[r"class\.module\.classloader", r"class\.classloader", r"pipeline\.first\.(?:pattern|suffix|prefix|directory)",
                 r"spring\.cloud\.function", "/functionrouter", "/actuator/gateway/routes"],
          marks=["class%2emodule", f"class{LBRACKET}{QUOTE}?(?:module|classloader)"]),
    # CVE-2017-5638, CVE-2018-11776 and earlier OGNL advisories
    _rule("struts_ognl", "critical", "OGNL expression injection",
          words=["_memberaccess", "allowstaticmethodaccess", r"ognl\.ognlcontext", r"com\.opensymphony\.xwork2"],
          marks=[f"{HASH}(?:context|parameters|attr|application|session|request){DOT}?{LBRACKET}",
                 f"(?:%25|%)(?:\\{{|%7b)[^}}]{{0,80}}(?:@|%40|{HASH}|{LPAR})", "(?:@|%40)java\\.(?:lang|io)\\b",
                 f"\\b(?:redirect|redirectaction|action|method){COLON}(?:{DOLLAR}|{HASH}|%25|%7b|\\{{)"]),
    # CWE-93, CWE-113
    _rule("crlf_injection", "medium", "Line break smuggled into a header",
          marks=["%0d%0a", "%250d%250a", "%e5%98%8a",
                 f"{NEWLINE}{BLANK}*(?:set-cookie|location|content-type|content-length|host|link|refresh|x-[a-z-]{{1,30}}){COLON}",
                 f"{NEWLINE}http(?:/|%2f)1"]),
    # CWE-601
    _rule("open_redirect", "medium", "Redirect parameter with an absolute target",
          words=_param(_LANDING, "//"),
          marks=[*_param(_LANDING, f"https?{_SCHEME_END}"), *_param(_LANDING, "(?:/%2f|%2f/|%2f%2f|/\\\\|\\\\|/%5c|%5c)")]),
    # Published research on path normalisation; override headers of reverse proxies
    _rule("access_bypass", "high", "Path confusion or header override to pass access rules",
          words=[r"/\./", "//(?:admin|manager|console|actuator)\\b", "x-(?:original|rewrite)-url", "x-http-method-override",
                 "x-custom-ip-authorization"],
          marks=[f"{DOT}{DOT}(?:;|%3b){SLASH}", "/(?:;|%3b)/", "(?:/|%2f)%2e(?:/|%2f)", "%ef%bc%8f",
                 "/(?:admin|manager|console|actuator)(?:%09|%0a|%23|%3f|%3b|;)"]),
    # CWE-538; usual file names of the tools concerned
    _rule("sensitive_file", "high", "Request for secrets, backups or configuration",
          words=[r"/\.env\b", r"/\.git\b", r"/\.svn\b", r"/\.hg/", r"/\.aws/", r"/\.ssh/", r"/\.kube/", r"/\.docker", r"/\.npmrc",
                 r"/\.netrc", r"/\.pgpass", r"/\.htaccess", r"/\.htpasswd", r"/\.bash_history", r"/\.ds_store", r"/\.vscode/",
                 r"/\.idea/", r"/wp-config\.php", r"/web\.config\b", r"/appsettings[a-z.]{0,20}\.json", r"/database\.ya?ml",
                 r"/secrets?\.(?:json|ya?ml|txt)", r"/credentials\b", r"/docker-compose\.ya?ml", "/id_(?:rsa|dsa|ecdsa|ed25519)\\b",
                 "/server-status", "/server-info", r"/phpinfo\.php", r"\.(?:sql|bak|swp|pem|pfx|p12|kdbx|jks|ppk|sqlite3?)(?:$|\?)",
                 r"\.sql\.(?:gz|zip|bz2)", r"/(?:backup|dump|database|htdocs|www)\.(?:zip|tar|tgz|rar|7z)"]),
    # CWE-158, CWE-174
    _rule("null_byte", "medium", "Null byte or doubly encoded path",
          marks=["%00", "%u0000", "%25(?:00|2e|2f|5c|3c|3e|27|22|3b)"]),
    # Components with entries in public vulnerability catalogues, and usual paths of admin panels
    _rule("cve_probe", "medium", "Probe for an admin panel or known vulnerable component",
          words=["/phpmyadmin", "/pma/", "/adminer", "/manager/html", "/host-manager/", "/jmx-console", "/invoker/", "/jolokia",
                 "/actuator\\b", "/solr/admin", "/wls-wsat/", "/_async/", "/console/login", "/vendor/phpunit/", r"eval-stdin\.php",
                 "/boaform/", "/gponform/", "/hnap1", r"/setup\.cgi", "/cgi-bin/luci", r"/cgi-bin/\.", r"/icons/\.",
                 "/tmui/", "/mgmt/tm/util/", "/remote/fgt_lang", "/remote/logincheck", "/dana-na/", "/vpns/", r"/\+cscoe\+/",
                 "/owa/auth", r"/autodiscover/autodiscover\.json", "/ecp/", r"/xmlrpc\.php", r"/wp-login\.php", "/wp-admin/",
                 r"/administrator/index\.php", "element_parents=", "/geoserver/", "/nacos/", "/druid/", "/struts2?-showcase",
                 r"/createpage-entervariables\.action", r"/setup/setupadministrator", "/public/plugins/", "invokefunction",
                 "allow_url_include", "/moveitisapi", "/zabbix", "/nagios", "/cacti/"],
          marks=["/cgi-bin/%2e", "/icons/%2e", "/console/(?:css|images)/%252e"]),
    # Vendor documentation of the server: diagnostic handlers and protected folders
    _rule("iis_aspnet", "medium", "Probe of an ASP.NET or IIS handler",
          words=[r"/(?:trace|elmah|glimpse)\.axd", "/app_(?:data|code|browsers)/", r"/global\.asax", "/_vti_(?:bin|pvt|cnf|inf)",
                 "/aspnet_client/", "/aspnet_webadmin", "/iisadmin", "/msadc/", "/certsrv/", r"/bin/[a-z0-9_.]{1,60}\.dll",
                 r"\.(?:ida|idq|htr|printer)(?:$|\?)", "~1/", r"~1\."],
          marks=[f"{_COLON2}{DOLLAR}data", r"~1(?:\*|%2a)", f"/{LPAR}s{LPAR}[a-z]{LPAR}"]),
    # Documentation of scanners and of the discovery interfaces they read
    _rule("recon_probe", "low", "Fuzzing or discovery artefact",
          words=["rest_route=/", "/wp-json/wp/", r"\?author=[0-9]", "/nmaplowercheck", r"trinity\.txt\.bak", "acunetix", "netsparker",
                 "/w00tw00t", "=fuzz(?:&|$)", "/fuzz(?:/|$)", "/swagger", "/api-docs", r"/openapi\.json", "__schema", "/graphiql",
                 r"/test\.(?:php|cgi|aspx?)\b", r"/info\.php\b", r"\?=php[a-f0-9]{8}-"]),
)

# --- fixed values: phase sets, lists and thresholds that decide the results --
EXPLOIT_TAGS = frozenset({
    "sqli", "nosqli", "command_injection", "shellshock", "ssti", "ldap_injection",
    "xpath_injection", "xss", "lfi_traversal", "rfi", "ssrf", "xxe", "deserialization",
    "log4shell", "spring4shell", "struts_ognl", "crlf_injection", "open_redirect",
    "access_bypass",
})
POSTEXPLOIT_TAGS = frozenset({"webshell"})
RECON_TAGS = frozenset({"cve_probe", "iis_aspnet", "sensitive_file", "recon_probe", "null_byte"})

SCANNER_UAS = (
    "sqlmap", "nikto", "nuclei", "gobuster", "dirbuster", "dirb", "dirsearch",
    "wpscan", "joomscan", "droopescan", "cmsmap", "wfuzz", "ffuf", "feroxbuster",
    "arachni", "acunetix", "netsparker", "burpsuite", "burp", "owasp zap", "zaproxy",
    "vega", "skipfish", "w3af", "whatweb", "wappalyzer", "httprint", "commix",
    "xsstrike", "nosqlmap", "sqlninja", "jsql", "havij", "pangolin",
    "nmap", "masscan", "zgrab", "zmap", "shodan", "censys", "netcraft",
    "fscan", "goby", "xray", "rustscan", "naabu",
    "metasploit", "hydra", "medusa", "patator", "crackmapexec", "impacket",
    "python-requests", "python-urllib", "go-http-client", "curl/", "wget/",
    "libwww-perl", "winhttp", "okhttp", "httpclient", "java/", "aiohttp",
    "node-fetch", "axios/", "guzzle", "mechanize", "scrapy", "phantomjs",
    "headlesschrome", "selenium",
    "l9explore", "l9tcpid", "internetmeasurement", "custom-asynchttp",
    "hello world", "mozila", "morfeus", "zmeu", "muieblackcat", "jaws",
)
UNCOMMON_METHODS = ("PUT", "DELETE", "TRACE", "CONNECT", "PROPFIND", "MKCOL", "MOVE", "COPY",
                    "LOCK", "UNLOCK", "SEARCH", "DEBUG", "TRACK", "PATCH")
AUTH_FAILURES = (401, 403)
BRUTE_FORCE_WINDOW_SECONDS = 300
BRUTE_FORCE_THRESHOLD = 20
ENUM_404_THRESHOLD = 50
RARE_UA_MAX_COUNT = 5
SPIKE_ZSCORE = 3.0
SPIKE_MIN_HOURS = 6
EXFIL_MIN_BYTES = 10 * 1024 * 1024
EXFIL_MIN_IPS = 5
SESSION_GAP_SECONDS = 1800
PHASES = ("benign", "recon", "exploitation", "post-exploitation", "exfiltration")

DEFAULT_RULES = RuleSet(_RULES, EXPLOIT_TAGS, POSTEXPLOIT_TAGS, RECON_TAGS)
