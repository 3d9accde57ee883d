"""Signature matching: which lines hold which attack patterns, and the findings from them."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from huntframe.functions.patterns import FOLDED, ascii_pattern, java_pattern
from huntframe.functions.scalars import ADDRESS_FIRST, is_ascii
from huntframe.operators.keyed import KeyedRule, keyed_findings, quoted

DETECTOR = "Pattern Detector"
PATH, TEXT, AGENT, LINE = "http_path", "message", "user_agent", "raw"


@dataclass(frozen=True)
class Signature:
    """A pattern as Python reads it, the fields it is looked for in, and what a hit means. Pass your own list to any operator here."""

    name: str
    fields: tuple[str, ...]
    pattern: str
    description: str
    score: int
    tags: tuple[tuple[str, str, str], ...]


_EXPLOIT = ("T1190", "Exploit Public-Facing Application", "Initial Access")
_BRUTE = ("T1110", "Brute Force", "Credential Access")
WEB = (PATH, TEXT, LINE)

# The signatures (name, fields, regex, description, base score, techniques).
SIGNATURES = (
    Signature("sql_injection", WEB, r"(?i)(?:'|\%27|--|;|/\*|\*/|0x[0-9a-f]+)(?:.*?(?:select|union|insert|update|delete|drop|exec|execute|cast\(|convert\(|char\(|declare|xp_cmdshell|information_schema|sleep\(|benchmark\(|pg_sleep|waitfor\s+delay))", "SQL Injection attempt detected in request", 75, (_EXPLOIT,)),
    Signature("xss_attempt", WEB, r"(?i)(?:<script|javascript:|on(?:load|error|click|mouse|key|focus|blur|change)\s*=|alert\s*\(|eval\s*\(|document\.cookie|window\.location)", "Cross-Site Scripting (XSS) attempt detected", 55, (_EXPLOIT,)),
    Signature("path_traversal", WEB, r"(?i)(?:\.\./|\.\.\\|%2e%2e%2f|%2e%2e/|\.%2e/|%2e\./|%252e%252e|\.\.%5c|%c0%ae|%c1%9c)(?:.*?(?:etc/passwd|etc/shadow|win/system32|boot\.ini|proc/self))?", "Path traversal / directory traversal attempt", 65, (("T1083", "File and Directory Discovery", "Discovery"),)),
    Signature("command_injection", WEB, r"(?i)(?:;|\||\`|\$\(|&&|\|\|)\s*(?:cat|ls|id|whoami|uname|pwd|wget|curl|nc|ncat|netcat|bash|sh|python|perl|php|ruby)\b", "Command injection attempt detected", 85, (("T1059", "Command and Scripting Interpreter", "Execution"),)),
    Signature("log4shell", (PATH, TEXT, AGENT, LINE), r"(?i)\$\{(?:jndi|j(?:&#x6e;|n)di|j\$\{)|jndi:\w{1,5}://", "Log4Shell (CVE-2021-44228) exploitation attempt", 95, (_EXPLOIT, ("T1059.001", "PowerShell", "Execution"))),
    Signature("shellshock", (PATH, AGENT, TEXT, LINE), r"\(\s*\)\s*\{.*?;.*?(?:bash|sh|ksh|zsh|csh|echo|cat)\b", "ShellShock (CVE-2014-6271) exploitation attempt", 90, (_EXPLOIT,)),
    Signature("php_injection", WEB, r"(?i)(?:php://(?:input|filter|data)|eval\(base64_decode|system\(|passthru\(|shell_exec\(|popen\(|proc_open\(|assert\(|preg_replace\()", "PHP code injection or file wrapper abuse attempt", 80, (("T1059.004", "Unix Shell", "Execution"),)),
    Signature("sensitive_file_access", WEB, r"(?i)(?:/etc/passwd|/etc/shadow|/etc/hosts|/proc/self/|\.git/config|\.env|wp-config\.php|config\.php|web\.config|application\.properties|\.htpasswd|id_rsa|authorized_keys|\.bash_history|\.ssh/)", "Attempt to access sensitive file or configuration", 70, (("T1552.001", "Credentials In Files", "Credential Access"),)),
    Signature("scanner_useragent", (AGENT, LINE), r"(?i)(?:nikto|nessus|nmap|masscan|zgrab|nuclei|sqlmap|gobuster|dirb|dirbuster|wfuzz|ffuf|burpsuite|openvas|qualys|rapid7|acunetix|metasploit|msfconsole|python-requests/|go-http-client/|libwww-perl/|curl/[0-9]|wget/[0-9])", "Known scanner or attack tool user-agent detected", 60, (("T1595", "Active Scanning", "Reconnaissance"),)),
    Signature("web_path_enumeration", (PATH,), r"(?i)(?:admin(?:\.php|panel|login|/)|wp-admin|wp-login|phpmyadmin|\.git/|\.svn/|backup|dump\.sql|\.bak|\.swp|\.DS_Store|robots\.txt|sitemap\.xml|xmlrpc\.php|/cgi-bin/|/actuator/|/api/swagger|/v1/api-docs)", "Web path enumeration / admin panel discovery attempt", 40, (("T1595.003", "Wordlist Scanning", "Reconnaissance"),)),
    Signature("ssh_root_login_attempt", (TEXT, LINE), r"(?i)(?:failed|invalid|error).{0,30}root.{0,30}(?:ssh|port)", "SSH login attempt for root account", 50, (("T1110.001", "Password Guessing", "Credential Access"),)),
    Signature("multiple_auth_failure", (TEXT, LINE), r"(?i)(?:failed password|authentication failure|login failed|logon failure|invalid credentials|failed login|auth failed)", "Authentication failure detected", 35, (_BRUTE,)),
    Signature("account_lockout", (TEXT, LINE), r"(?i)(?:account.{0,20}locked|locked.{0,20}out|too many.{0,20}attempt|maximum.{0,20}retries)", "Account lockout event — possible brute force", 60, (_BRUTE,)),
    Signature("privilege_escalation", (TEXT, LINE), r"(?i)(?:special privilege|privilege assigned|sudo.{0,30}(?:root|ALL|PASSWD)|su:.{0,20}success|SeDebugPrivilege|SeTcbPrivilege|SeLoadDriverPrivilege)", "Privilege escalation activity detected", 70, (("T1078", "Valid Accounts", "Privilege Escalation"), ("T1548", "Abuse Elevation Control Mechanism", "Privilege Escalation"))),
    Signature("new_service_or_task", (TEXT, LINE), r"(?i)(?:new service installed|scheduled task created|service.{0,20}install|schtasks.{0,20}/create|at\.exe|crontab -[li])", "New service or scheduled task created — possible persistence", 65, (("T1543", "Create or Modify System Process", "Persistence"), ("T1053", "Scheduled Task/Job", "Persistence"))),
    Signature("log_cleared", (TEXT, LINE), r"(?i)(?:audit log.{0,20}clear|log.{0,20}cleared|event log.{0,20}clear|wevtutil.{0,20}cl)", "Security/audit log was cleared — possible cover-up", 90, (("T1070.001", "Clear Windows Event Logs", "Defense Evasion"),)),
    Signature("data_exfiltration_hint", (TEXT, LINE), r"(?i)(?:wget.{0,50}(?:http|ftp)|curl.{0,50}(?:http|ftp)|scp.{0,50}(?:\d{1,3}\.){3}\d{1,3}|nc.{0,30}(?:\d{1,3}\.){3}\d{1,3}.{0,10}\d{4,5}|base64.{0,30}(?:decode|encode).{0,30}(?:>|>>|\|))", "Potential data exfiltration or remote staging command", 75, (("T1041", "Exfiltration Over C2 Channel", "Exfiltration"),)),
)


#: By signature, lower-case texts of which every match holds one at least. They are looked for first, all of them in one
#: reading of one lower-cased text an entry; the pattern is tried only where one is there. A signature that is not listed is always tried.
NEEDS = {
    "sql_injection": ("select", "union", "insert", "update", "delete", "drop", "exec", "cast(", "convert(", "char(", "declare", "xp_cmdshell", "information_schema", "sleep", "benchmark(", "waitfor"),
    "xss_attempt": ("<script", "javascript:", "onload", "onerror", "onclick", "onmouse", "onkey", "onfocus", "onblur", "onchange", "alert", "eval", "document.cookie", "window.location"),
    "path_traversal": ("../", "..\\", "%2e", "%252e", "..%5c", "%c0%ae", "%c1%9c"),
    "command_injection": (";", "|", "`", "$(", "&&"),
    "log4shell": ("${j", "jndi:"),
    "shellshock": (";",),
    "php_injection": ("php://", "eval(base64_decode", "system(", "passthru(", "shell_exec(", "popen(", "proc_open(", "assert(", "preg_replace("),
    "sensitive_file_access": ("/etc/", "/proc/self/", ".git/config", ".env", "config.php", "web.config", "application.properties", ".htpasswd", "id_rsa", "authorized_keys", ".bash_history", ".ssh/"),
    "scanner_useragent": ("nikto", "nessus", "nmap", "masscan", "zgrab", "nuclei", "sqlmap", "gobuster", "dirb", "wfuzz", "ffuf", "burpsuite", "openvas", "qualys", "rapid7", "acunetix", "metasploit", "msfconsole", "python-requests/", "go-http-client/", "libwww-perl/", "curl/", "wget/"),
    "web_path_enumeration": ("admin", "wp-login", ".git/", ".svn/", "backup", "dump.sql", ".bak", ".swp", ".ds_store", "robots.txt", "sitemap.xml", "xmlrpc.php", "/cgi-bin/", "/actuator/", "/api/swagger", "/v1/api-docs"),
    "ssh_root_login_attempt": ("root",),
    "multiple_auth_failure": ("failed", "failure", "invalid credentials"),
    "account_lockout": ("locked", "too many", "maximum"),
    "privilege_escalation": ("privilege", "sudo", "su:"),
    "new_service_or_task": ("service", "task", "at.exe", "crontab"),
    "log_cleared": ("clear", "wevtutil"),
    "data_exfiltration_hint": ("wget", "curl", "scp", "nc", "base64"),
}


def searched(log: DataFrame, signatures: tuple[Signature, ...] = SIGNATURES) -> DataFrame:
    """log with the column `met`: the places of the signatures that each entry meets.

    The signatures' fields are looked through as one lower-cased text first, which leaves out what the line itself holds. All of it is one array function, which
    Spark evaluates as it is: as generated code it would be one method, too long for the JVM ever to compile.
    """
    fields = sorted({f for s in signatures for f in s.fields})
    apart = [F.when(~F.coalesce(F.contains(LINE, f), F.lit(False)), F.col(f)) if f != LINE and LINE in fields else F.col(f) for f in fields]
    low = log.withColumn("_text", F.concat_ws("\n", *apart)).withColumns({"_low": _folded("_text"), "_ascii": is_ascii(F.col("_text"))})
    needs = {i: NEEDS[s.name] for i, s in enumerate(signatures) if s in SIGNATURES and s.name in NEEDS}
    always = [i for i in range(len(signatures)) if i not in needs]
    words = sorted({t for texts in needs.values() for t in texts})
    low = low.withColumn("_words", F.array_distinct(F.regexp_extract_all("_low", F.lit(_any_of(words)), F.lit(1))) if words else F.array().cast("array<string>"))
    tried = lambda i: f"arrays_overlap(_words, array({', '.join(quoted(w) for w in words if any(w.startswith(t) for t in needs[i]))})) AND " if i in needs else ""
    cases = " ".join(f"WHEN {i} THEN {tried(i)}({_hits(s)})" for i, s in enumerate(signatures))
    places = f"CASE WHEN size(_words) = 0 THEN cast(array({', '.join(map(str, always))}) AS array<int>) ELSE sequence(0, {len(signatures) - 1}) END"
    return low.withColumn("met", F.expr(f"filter({places}, i -> CASE i {cases} END)" if signatures else "cast(array() AS array<int>)")).drop("_low", "_text", "_ascii", "_words")


def _any_of(words: list[str]) -> str:
    """A pattern that finds, at every place of a text, the longest of the words that begins there; shorter ones are beginnings of it. Words of one first character share a branch."""
    escaped = lambda text: re.sub(r"([^A-Za-z0-9 \n])", r"\\\1", text)
    firsts: dict[str, list[str]] = {}
    for word in sorted(words, key=len, reverse=True):
        firsts.setdefault(word[0], []).append(escaped(word[1:]))
    return f"(?=[{''.join(map(escaped, firsts))}])(?=(" + "|".join(f"{escaped(c)}(?:{'|'.join(rest)})" for c, rest in firsts.items()) + "))"


def _folded(text: str) -> Column:
    """Lower case as the patterns see it: also the few characters beyond ASCII that count as ASCII letters. ASCII text, which is no longer than its bytes, is only lower-cased."""
    return F.lower(F.when(F.octet_length(text) > F.length(text), F.translate(text, "".join(FOLDED), "".join(FOLDED.values()))).otherwise(F.col(text)))


def _hits(signature: Signature) -> str:
    """Whether one of the signature's fields holds its pattern, in SQL."""
    java, plain = quoted(java_pattern(signature.pattern)), quoted(ascii_pattern(signature.pattern))
    return " OR ".join(f"coalesce(if(_ascii, {f} RLIKE {plain}, {f} RLIKE {java}), false)" for f in signature.fields)


def pattern_hits(log: DataFrame, signatures: tuple[Signature, ...] = SIGNATURES) -> DataFrame:
    """One row per entry and signature that it meets, with the signature's place in the list. Map-only: only hits are exploded."""
    table = F.array(*(F.struct(F.lit(s.name).alias("finding_type"), F.lit(s.score).alias("base_score")) for s in signatures)).cast("array<struct<finding_type:string,base_score:int>>")
    hits = searched(log, signatures).withColumn("signature_rank", F.explode_outer("met")).filter("signature_rank IS NOT NULL")  # see rule_hits
    return hits.withColumn("_hit", F.get(table, F.col("signature_rank"))).select(*log.columns, "signature_rank", "_hit.*")


def signature_rules(signatures: tuple[Signature, ...] = SIGNATURES) -> list[KeyedRule]:
    """The signatures as rules by source: score raised above 5 and 20 hits. They need the column `met`, which `searched` adds."""
    return [
        KeyedRule(
            name=s.name,
            meets=f"array_contains(met, {i})",
            key=ADDRESS_FIRST,
            enough="true",
            score=f"{s.score} + if(count > 5, 10, 0) + if(count > 20, 15, 0)",
            text=f"concat({quoted(s.description)}, ' (', count, if(count > 1, ' events)', ' event)'))",
            tags=s.tags,
            detector=DETECTOR,
            detector_rank=0,
            rule_rank=0,
            in_turn=i,
        )
        for i, s in enumerate(signatures)
    ]


def pattern_findings(log: DataFrame, signatures: tuple[Signature, ...] = SIGNATURES) -> DataFrame:
    """Hits by signature and source: count, score raised above 5 and 20 hits, and the first hit's address, user and time."""
    return keyed_findings(searched(log, signatures), signature_rules(signatures))
