"""Lookup tables, word lists, thresholds. They define results, so they are stated in full."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Syntax node type -> (IR type, category, base risk); anything else is (EXPR, data_flow, 0).
NODE_TYPES = {
    "Assert": ("ASSERT", "validation", 0), "AnnAssign": ("ASSIGN", "data_flow", 0), "Assign": ("ASSIGN", "data_flow", 0), "AugAssign": ("ASSIGN", "data_flow", 0), "NamedExpr": ("ASSIGN", "data_flow", 1),
    "GO": ("ASYNC_SPAWN", "async", 2), "AWAIT": ("AWAIT", "async", 1), "Await": ("AWAIT", "async", 1), "BinOp": ("BIN_OP", "data_flow", 0), "BoolOp": ("BOOL_OP", "data_flow", 0),
    "CASE": ("BRANCH", "control_flow", 0), "ELSE": ("BRANCH", "control_flow", 0), "ELIF": ("BRANCH", "control_flow", 1), "IF": ("BRANCH", "control_flow", 1), "If": ("BRANCH", "control_flow", 1), "SELECT": ("BRANCH", "control_flow", 1), "SWITCH": ("BRANCH", "control_flow", 1), "UNLESS": ("BRANCH", "control_flow", 1),
    "Break": ("BREAK", "control_flow", 0), "Call": ("CALL", "execution", 2), "CATCH": ("CATCH", "exception", 1), "ExceptHandler": ("CATCH", "exception", 1), "RESCUE": ("CATCH", "exception", 1),
    "CLASS_DEF": ("CLASS_DEF", "structure", 1), "ClassDef": ("CLASS_DEF", "structure", 1), "Compare": ("COMPARE", "data_flow", 0), "DictComp": ("COMPREHENSION", "data_flow", 1), "GeneratorExp": ("COMPREHENSION", "data_flow", 1), "ListComp": ("COMPREHENSION", "data_flow", 1), "SetComp": ("COMPREHENSION", "data_flow", 1),
    "FINALLY": ("CONTEXT", "exception", 0), "DEFER": ("CONTEXT", "resource", 1), "With": ("CONTEXT", "resource", 1), "AsyncWith": ("CONTEXT", "resource", 2), "Continue": ("CONTINUE", "control_flow", 0), "Delete": ("DELETE", "data_flow", 2),
    "FUNC_DEF": ("FUNC_DEF", "structure", 1), "FunctionDef": ("FUNC_DEF", "structure", 1), "AsyncFunctionDef": ("FUNC_DEF", "structure", 2), "comprehension": ("GENERATOR", "data_flow", 1), "Global": ("GLOBAL", "scope", 6),
    "IMPORT": ("IMPORT", "dependency", 2), "Import": ("IMPORT", "dependency", 2), "ImportFrom": ("IMPORT", "dependency", 2), "Lambda": ("LAMBDA", "structure", 3),
    "FOR": ("LOOP", "control_flow", 1), "For": ("LOOP", "control_flow", 1), "LOOP": ("LOOP", "control_flow", 1), "WHILE": ("LOOP", "control_flow", 1), "While": ("LOOP", "control_flow", 1), "AsyncFor": ("LOOP", "control_flow", 2),
    "MATCH": ("MATCH", "control_flow", 1), "Match": ("MATCH", "control_flow", 1), "Expression": ("MODULE", "structure", 0), "Interactive": ("MODULE", "structure", 0), "Module": ("MODULE", "structure", 0), "Nonlocal": ("NONLOCAL", "scope", 3), "Pass": ("PASS", "control_flow", 0),
    "Raise": ("RAISE", "exception", 2), "RETURN": ("RETURN", "control_flow", 0), "Return": ("RETURN", "control_flow", 0), "Subscript": ("SUBSCRIPT", "data_flow", 0), "IfExp": ("TERNARY", "control_flow", 0), "DEPTH_LIMIT": ("TRUNCATED", "structure", 0),
    "TRY": ("TRY", "exception", 1), "Try": ("TRY", "exception", 1), "TryStar": ("TRY", "exception", 1), "UnaryOp": ("UNARY_OP", "data_flow", 0), "Starred": ("UNPACK", "data_flow", 1), "Yield": ("YIELD", "generator", 1), "YieldFrom": ("YIELD", "generator", 2),
}

# Category multipliers (others 1.0) and least risks by IR type.
MULTIPLIERS = {
    "validation": 0.8, "control_flow": 1.0, "data_flow": 1.0, "exception": 1.0, "generator": 1.0, "structure": 1.0, "async": 1.1, "dependency": 1.1, "resource": 1.1, "concurrency": 1.2, "execution": 1.2,
    "memory": 1.3, "io": 1.4, "scope": 1.5, "hook": 1.6, "network": 1.8, "privilege": 2.0, "dynamic": 2.2, "taint": 2.5,
}
LEAST_8 = ("DYNAMIC", "NETWORK", "OBFUSC", "PRIVILEGE")
LEAST_6 = ("DESER", "DYNAMIC_IMPORT", "EVAL", "EXEC", "GLOBAL", "HOOK", "NATIVE_LOAD", "SYS_POISON", "TAINTED_EXEC")

# The token vocabulary in vector order, and the types repeated at a sequence's end.
VOCABULARY = (
    "MODULE FUNC_DEF CLASS_DEF LAMBDA IMPORT CALL AWAIT ASYNC_SPAWN ASSIGN DELETE UNPACK BOOL_OP BIN_OP UNARY_OP COMPARE SUBSCRIPT BRANCH LOOP MATCH TERNARY RETURN BREAK CONTINUE PASS GLOBAL NONLOCAL TRY CATCH RAISE CONTEXT YIELD "
    "COMPREHENSION GENERATOR DYNAMIC PRIVILEGE NETWORK OBFUSC IO DESER MEMORY CONCUR HOOK NATIVE_LOAD SYS_POISON TAINTED_EXEC DEL_HOOK SUBCLASS_HOOK WEAKREF_HOOK FILE_WRITE THREAD_LOCAL ASSERT EXPR TRUNCATED"
).split()
AMPLIFIED = "DEL_HOOK DESER DYNAMIC FILE_WRITE GLOBAL HOOK LAMBDA MEMORY NATIVE_LOAD NETWORK OBFUSC PRIVILEGE SUBCLASS_HOOK SYS_POISON TAINTED_EXEC THREAD_LOCAL".split()
SEQUENCE, TAIL = 512, 128
TREE_DEPTH, IR_DEPTH, MAX_SOURCE, MAX_NODES = 80, 60, 5 << 20, 200_000

# Edge labels by IR type; others "uses".
EDGE_LABELS = {
    "IMPORT": "imports", "CALL": "calls", "AWAIT": "calls", "ASYNC_SPAWN": "calls", "CLASS_DEF": "defines", "FUNC_DEF": "defines", "CATCH": "handles", "TRY": "handles",
    "DYNAMIC": "risks", "PRIVILEGE": "risks", "NETWORK": "risks", "OBFUSC": "risks", "SYS_POISON": "risks", "NATIVE_LOAD": "risks", "TAINTED_EXEC": "risks", "GLOBAL": "scopes", "NONLOCAL": "scopes",
    "IO": "accesses", "DESER": "accesses", "MEMORY": "accesses", "CONCUR": "spawns", "HOOK": "hooks", "DEL_HOOK": "hooks", "SUBCLASS_HOOK": "hooks",
}

# Rows added for file flags, in order: flags, IR type, category, risk, source, counters raised.
INJECTED = [
    ("has_exec_calls", "DYNAMIC", "privilege", 9, "exec_detected", "dyn priv"), ("has_eval_calls", "DYNAMIC", "privilege", 9, "eval_detected", "dyn priv"), ("has_dynamic_imports", "DYNAMIC", "dependency", 7, "dynamic_import", "dyn"),
    ("has_network_calls", "NETWORK", "network", 6, "network_detected", "net"), ("has_file_io", "IO", "io", 4, "file_io_detected", "io"), ("has_privilege_calls", "PRIVILEGE", "privilege", 8, "privilege_detected", "priv"),
    ("has_obfuscation", "OBFUSC", "dynamic", 8, "obfuscation_detected", "dyn"), ("has_high_entropy", "OBFUSC", "dynamic", 7, "entropy_blob_detected", "dyn"), ("has_injection_risk", "DYNAMIC", "execution", 9, "injection_detected", "dyn"),
    ("has_deserialisation", "DESER", "execution", 8, "deserialisation_detected", "dyn"), ("has_reflection", "DYNAMIC", "scope", 6, "reflection_detected", "dyn"), ("has_exception_silence", "CATCH", "exception", 3, "silent_exception", ""),
    ("has_metaclass", "CLASS_DEF", "scope", 4, "metaclass_detected", ""), ("has_dynamic_attr_set", "DYNAMIC", "scope", 6, "dynamic_attr_set", "dyn"), ("has_pickle_gadgets", "HOOK", "dynamic", 8, "pickle_gadget_detected", "dyn"),
    ("has_sys_modules_poison", "DYNAMIC", "dynamic", 9, "sys_modules_poison", "dyn"), ("has_native_lib_load", "PRIVILEGE", "privilege", 7, "native_lib_load", "priv"), ("has_concurrency", "CONCUR", "concurrency", 4, "concurrency_detected", ""),
    ("has_crypto_ops", "IO", "io", 2, "crypto_ops_detected", ""), ("has_tainted_exec has_tainted_eval", "TAINTED_EXEC", "taint", 10, "tainted_exec_detected", "dyn"), ("has_del_hook", "HOOK", "hook", 7, "del_hook_detected", "dyn"),
    ("has_subclass_hook", "HOOK", "hook", 6, "subclass_hook_detected", "dyn"), ("has_missing_hook", "HOOK", "hook", 5, "missing_hook_detected", ""), ("has_fspath_hook", "HOOK", "hook", 5, "fspath_hook_detected", ""),
    ("has_weakref_hooks", "HOOK", "hook", 5, "weakref_hook_detected", ""), ("has_file_write", "IO", "io", 6, "file_write_detected", "io"), ("has_format_injection", "DYNAMIC", "execution", 5, "format_injection_surface", ""), ("has_thread_local", "CONCUR", "concurrency", 6, "thread_local_detected", ""),
]

# Names and modules that raise a flag of a Python file.
CALL_NAMES = {
    "has_exec_calls": "exec execfile", "has_eval_calls": "eval", "has_compile_calls": "compile", "has_dynamic_imports": "__import__ exec_module find_loader import_module load_dynamic load_extension load_source",
    "has_deserialisation": "Unpickler load loads",
    "has_privilege_calls": "CDLL CFUNCTYPE Popen WinDLL call cdll check_call check_output chroot dlopen execv execve execvp execvpe fork forkpty kill killpg popen ptrace raise_signal run setgid setresgid setresuid setuid spawn spawnl spawnle system windll",
    "has_network_calls": "AsyncClient Client ClientSession accept bind connect create_connection delete download fetch get listen patch post put recv recvfrom send sendto socket upload urlopen urlretrieve",
    "has_file_io": "copy copy2 copyfile flush listdir makedirs mkdir move open read readline readlines remove rmdir rmtree scandir seek truncate unlink walk write",
    "has_obfuscation": "a85decode b32decode b64decode b64encode b85decode decodebytes decompress decompressobj encodebytes fromhex rot13 unhexlify",
    "has_reflection": "__builtins__ delattr dir getattr globals hasattr inspect isinstance issubclass locals setattr type vars", "has_injection_risk": "cursor execute executemany extra format query raw",
    "has_concurrency": "Condition Lock Pool Process ProcessPoolExecutor RLock Semaphore Thread ThreadPoolExecutor create_task ensure_future gather local", "has_weakref_hooks": "WeakKeyDictionary WeakSet WeakValueDictionary finalize proxy ref",
}
MODULE_NAMES = {
    "has_network_calls": "aiohttp ftplib grpc http httplib httpx imaplib paramiko pycurl requests smtplib socket ssl telnetlib tornado twisted urllib urllib2 urllib3 websockets xmlrpc",
    "has_file_io": "fileinput fnmatch glob io os os.path pathlib shutil tempfile", "has_obfuscation": "base64 binascii bz2 cloudpickle copyreg dill gzip lzma marshal msgpack pickle shelve zlib",
    "has_crypto_ops": "Crypto cryptography hashlib hmac jwt nacl pyotp secrets ssl", "has_concurrency": "asyncio celery concurrent joblib multiprocessing ray threading",
    "has_privilege_calls": "subprocess os pty signal ctypes cffi winreg", "has_weakref_hooks": "weakref",
}
PICKLE_NAMES = "__getnewargs__ __getnewargs_ex__ __getstate__ __reduce__ __reduce_ex__ __setstate__".split()
HOOK_NAMES = {"__del__": "has_del_hook", "__init_subclass__": "has_subclass_hook", "__missing__": "has_missing_hook", "__fspath__": "has_fspath_hook", "__class_getitem__": None, "__set_name__": None}

# File extensions -> parser, and -> language label.
PARSERS = {
    ".py": "python", ".js": "javascript", ".jsx": "javascript", ".ts": "javascript", ".tsx": "javascript", ".go": "go", ".java": "java", ".rs": "rust", ".rb": "ruby", ".cs": "csharp", ".cpp": "cpp", ".c": "cpp", ".h": "cpp", ".hpp": "cpp", ".php": "php", ".sh": "shell",
}
LANGUAGES = {".py": "Python", ".js": "JavaScript", ".ts": "TypeScript", ".go": "Go", ".rs": "Rust", ".java": "Java", ".rb": "Ruby", ".cs": "C#", ".cpp": "C++", ".php": "PHP", ".sh": "Shell"}
ALLOWED = [*PARSERS, ".yaml", ".yml", ".json", ".toml", ".ini", ".cfg"]

# Structural expressions by language: functions, classes, imports, control words, then exec, eval, dynamic import, network and file patterns.
GRAMMARS = {
    "base": (r"\bfunction\s+(\w+)\s*\(", r"\bclass\s+(\w+)", r"\bimport\s+", "if else for while switch try catch", r"\bexec\s*\(", r"\beval\s*\(", r"\b(?:require|import)\s*\(", r"\b(?:fetch|XMLHttpRequest|net\.|http\.|socket|connect)\s*\(", r"\b(?:open|read|write|fs\.|File|Stream)\s*[\.(]"),
    "javascript": (r"\b(?:function\s+(\w+)|(?:const|let|var)\s+(\w+)\s*=\s*(?:async\s+)?(?:function|\([^)]*\)\s*=>|\w+\s*=>))", r"\bclass\s+(\w+)", r"\b(?:import|require)\s*[\(\{\"']", "if else for while switch try catch finally", r"\beval\s*\(", r"\bFunction\s*\(", r"\bimport\s*\(", r"\b(?:fetch|XMLHttpRequest|axios|got|request)\s*[\.(]", r"\b(?:fs\.|readFile|writeFile|createReadStream)\s*"),
    "go": (r"\bfunc\s+(?:\(\w+\s+\*?\w+\)\s+)?(\w+)\s*\(", r"\btype\s+(\w+)\s+struct", r"\b(?:import\s+[\(\"]|import\s+\w+\s+\")", "if else for switch case select defer go", r"\bexec\.Command\s*\(", r"\bunsafe\.", r"\bplugin\.Open\s*\(", r"\b(?:net\.|http\.|dial|listen)\s*", r"\b(?:os\.Open|os\.Create|ioutil\.|bufio\.)\s*"),
    "java": (r"\b(?:public|private|protected|static|\s)+\w+\s+(\w+)\s*\([^)]*\)\s*(?:throws\s+\w+\s*)?\{", r"\b(?:class|interface|enum)\s+(\w+)", r"\bimport\s+[\w\.]+", "if else for while switch try catch finally", r"\bRuntime\.exec\s*\(", r"\bScriptEngine\b", r"\bClass\.forName\s*\(", r"\b(?:Socket|URL|HttpURLConnection|HttpClient)\s*[\.(]", r"\b(?:FileReader|FileWriter|InputStream|OutputStream)\s*[\.(]"),
    "rust": (r"\b(?:pub\s+)?(?:async\s+)?fn\s+(\w+)\s*[<(]", r"\b(?:struct|enum|trait|impl)\s+(\w+)", r"\buse\s+[\w:]+", "if else match for while loop return", r"\bCommand::new\s*\(", r"\bunsafe\s*\{", r"\blib::Library::new\s*\(", r"\b(?:TcpStream|UdpSocket|TcpListener)\s*::", r"\b(?:File::open|File::create|BufReader|BufWriter)\s*"),
    "ruby": (r"\bdef\s+(\w+[\?!]?)", r"\b(?:class|module)\s+(\w+)", r"\b(?:require|require_relative|include|extend)\s+", "if unless elsif else while until for begin rescue ensure case when", r"\beval\s*[\(\"'`]", r"\binstance_eval\s*\{", r"\brequire\s*\(", r"\b(?:Net::HTTP|TCPSocket|UDPSocket|open-uri)\b", r"\b(?:File\.open|IO\.read|File\.read)\s*"),
    "csharp": (r"\b(?:public|private|protected|static|async|\s)+\w+\s+(\w+)\s*\([^)]*\)\s*(?:\{|=>)", r"\b(?:class|interface|struct|enum)\s+(\w+)", r"\busing\s+[\w\.]+", "if else for foreach while switch try catch finally", r"\bProcess\.Start\s*\(", r"\bCompiler|CSharpCodeProvider\b", r"\bAssembly\.Load\s*\(", r"\b(?:TcpClient|HttpClient|WebClient|Socket)\s*[\.(]", r"\b(?:File\.|StreamReader|StreamWriter|FileStream)\s*"),
    "cpp": (r"\b(\w+)\s+(\w+)\s*\([^)]*\)\s*(?:const\s*)?\{", r"\b(?:class|struct|union)\s+(\w+)", r"#\s*include\s*[<\"]", "if else for while switch try catch", r"\b(?:system|popen|execve?|execl[pe]?)\s*\(", r"\bdlopen\s*\(", r"\bdlsym\s*\(", r"\b(?:socket|connect|bind|listen|send|recv)\s*\(", r"\b(?:fopen|fread|fwrite|open|read|write)\s*\("),
    "php": (r"\bfunction\s+(\w+)\s*\(", r"\b(?:class|interface|trait)\s+(\w+)", r"\b(?:require|include|require_once|include_once)\s*[\(\"'\\]", "if elseif else for foreach while switch try catch", r"\b(?:eval|exec|shell_exec|passthru|system)\s*\(", r"\beval\s*\(", r"\b(?:require|include)\s*\(\s*\$", r"\b(?:fsockopen|curl_init|file_get_contents)\s*\(", r"\b(?:fopen|file_put_contents|file_get_contents)\s*\("),
    "shell": (r"\b(\w+)\s*\(\s*\)\s*\{", None, r"\b(?:source|\.|import)\s+", "if elif else fi for while until case esac", r"\beval\s+", r"\bexec\s+", r"\bsource\s+\$", r"\b(?:curl|wget|nc|netcat|ncat|ssh)\s+", r"\b(?:cat|read|write|dd|tee)\s+"),
}
HASH_COMMENTS = ("ruby", "php", "shell", "python")

# Patterns over a file's nodes and what each adds to the risk.
BOOSTS = {
    "EXEC_CHAIN": 8, "EXFIL_CHAIN": 9, "OBFUSC_EXEC": 8, "DESER_EXEC": 8, "PRIV_NETWORK": 7, "DEEP_DYNAMIC": 6, "SILENT_EXCEPT": 4, "GLOBAL_WRITE": 5, "SHADOW_IMPORT": 4, "ASYNC_DYNAMIC": 7,
    "MULTI_OBFUSC": 6, "HOOK_PATTERN": 5, "CONCUR_PRIV": 6, "ENTROPY_EXEC": 7, "PICKLE_GADGET": 8, "NATIVE_CODE_LOAD": 7, "TAINTED_EXEC": 9, "HOOK_PERSIST": 7, "WEAKREF_EXFIL": 6,
}

# Policy rules (id, condition, severity, rejects, constraint) and constraints (id, type, severity).
RULES = [
    ("R001", "aggregate_risk >= 0.85D", "critical", True, None), ("R002", "aggregate_risk >= 0.60D", "high", False, "network_isolation"), ("R003", "high_risk_file_count > 3", "high", False, "sandboxed_execution"),
    ("R004", "privileged_api_count > 10", "high", False, "privilege_restriction"), ("R005", "anomalous_pattern_count > 5", "medium", False, "monitoring_required"), ("R006", "false", "critical", True, None),
]
#: R006 as it was meant; off unless asked for.
NETWORK_DYNAMIC = "array_contains(flags, 'NETWORK_ACCESS') AND array_contains(flags, 'DYNAMIC_EXECUTION')"
CONSTRAINTS = {"network_isolation": ("C001", "network_isolation", "mandatory"), "sandboxed_execution": ("C002", "sandboxed_execution", "mandatory"), "privilege_restriction": ("C003", "privilege_restriction", "mandatory"), "monitoring_required": ("C004", "monitoring", "recommended")}
MALICE_PAIRS = [("has_eval_calls", "has_dynamic_imports"), ("has_obfuscation", "has_high_entropy"), ("has_network_calls", "has_eval_calls"), ("has_privilege_calls", "has_injection_risk")]
MALICE_FLAGS = ["has_eval_calls", "has_dynamic_imports", "has_obfuscation", "has_privilege_calls", "has_injection_risk", "has_high_entropy"]

# Expected infrastructure, hint keywords, generated files by condition, restart points and hints for retries.
RESOURCES = ["azurerm_resource_group", "azurerm_virtual_network", "azurerm_subnet", "azurerm_network_security_group"]
RESOURCES_IF = {"sandboxed_execution": ["azurerm_container_group"], "network_isolation": ["azurerm_private_endpoint", "azurerm_private_dns_zone"], "monitoring_required": ["azurerm_log_analytics_workspace", "azurerm_monitor_activity_log_alert"]}
HINTS = {
    "Kubernetes client": "kubernetes_cluster aks kubernetes", "Docker API": "container_group container_registry acr", "Azure SDK": "azurerm azure", "AWS SDK": "aws", "GCP SDK": "google", "Database ORM": "sql_server postgresql mysql cosmosdb database",
    "Redis cache": "redis_cache redis", "Task queue": "servicebus queue eventhub", "Message streaming": "eventhub servicebus kafka", "SSH/remote execution": "virtual_machine bastion ssh",
}
FILES = [
    ("main.tf", "method <> 'none'"), ("nsg.tf", "method <> 'none'"), ("variables.tf", "method <> 'none'"), ("outputs.tf", "method <> 'none'"), ("container.tf", "array_contains(constraints, 'sandboxed_execution')"), ("monitoring.tf", "array_contains(constraints, 'monitoring_required')"),
    ("private_endpoint.tf", "array_contains(constraints, 'network_isolation')"), ("rbac.tf", "array_contains(constraints, 'privilege_restriction')"), ("keyvault_access.tf", "array_contains(constraints, 'privilege_restriction')"),
    ("site.yml", "method IN ('declarative', 'hybrid')"), ("roles/hardening/tasks/main.yml", "method IN ('declarative', 'hybrid')"), ("roles/hardening/handlers/main.yml", "method IN ('declarative', 'hybrid')"), ("deploy.sh", "method = 'imperative'"),
]
RESTART = {"RESOURCE_MISMATCH": "strategy", "HINT_MISMATCH": "strategy", "SYNTAX_ERROR": "generator", "PLAN_ERROR": "generator", "LINT_ERROR": "generator", "UNKNOWN_ERROR": "generator"}
RETRY_HINTS = {"SYNTAX_ERROR": "Correct the syntax of the generated files.", "PLAN_ERROR": "Correct names, required properties and dependencies.", "RESOURCE_MISMATCH": "Choose a strategy that provides the missing resources.", "HINT_MISMATCH": "Cover the services that the source uses.", "LINT_ERROR": "Correct the playbook's lint violations.", "UNKNOWN_ERROR": "Review the files and generate them again."}
SEVERITIES = ("debug", "info", "warning", "error", "critical")
ROLE_SIZES = {"secure_fetcher": (0.5, 0.5), "ast_parser": (0.25, 0.5), "ir_builder": (0.5, 0.5), "ml_analyzer": (1.0, 1.0), "policy_engine": (0.5, 0.5), "strategy_agent": (0.5, 0.5), "iac_generator": (0.5, 0.5), "deployment_agent": (0.5, 0.5)}

# Event constructors: event -> severity, stage.
EVENTS = {
    "TASK_STARTED": ("info", "init"), "TASK_STAGE": ("info", None), "TASK_COMPLETE": ("info", "complete"), "TASK_FAILED": ("error", "failed"), "VM_CREATED": ("info", "vm_lifecycle"), "VM_DESTROYED": ("info", "vm_lifecycle"), "SECURITY_EVENT": (None, "security"), "POLICY_DECISION": ("info", "policy"),
    "DEPLOYMENT_STRATEGY": ("info", "strategy"), "IAC_GENERATED": ("info", "iac"), "IAC_RETRY": ("warning", "iac"), "STRATEGY_RETRY": ("warning", "strategy"), "FEASIBILITY_PASSED": ("info", "feasibility"), "FEASIBILITY_FAILED": ("warning", "feasibility"),
    "DEPLOYMENT_STARTED": ("info", "deploy"), "DEPLOYMENT_COMPLETE": ("info", "deploy"), "ENVIRONMENT_TEARDOWN": ("info", "teardown"),
}

# Training vocabulary, token risks and threat classes (required tokens, likely tokens, risk, six label means).
TRAINING_VOCABULARY = "MODULE FUNC_DEF CLASS_DEF IMPORT CALL BRANCH LOOP ASSIGN RETURN RAISE TRY CATCH CONTEXT GLOBAL NONLOCAL DYNAMIC PRIVILEGE AWAIT YIELD LAMBDA COMPREHENSION ASSERT DELETE IO NETWORK EXPR TRUNCATED MATCH".split()
TOKEN_RISKS = {
    "MODULE": 0.0, "FUNC_DEF": 0.1, "CLASS_DEF": 0.1, "IMPORT": 0.2, "CALL": 0.2, "BRANCH": 0.1, "LOOP": 0.1, "ASSIGN": 0.0, "RETURN": 0.0, "RAISE": 0.2, "TRY": 0.1, "CATCH": 0.1, "CONTEXT": 0.1, "GLOBAL": 0.6, "NONLOCAL": 0.4, "DYNAMIC": 0.9, "PRIVILEGE": 0.8, "AWAIT": 0.1, "YIELD": 0.1, "LAMBDA": 0.3,
    "COMPREHENSION": 0.1, "ASSERT": 0.0, "DELETE": 0.3, "IO": 0.4, "NETWORK": 0.5, "EXPR": 0.0, "TRUNCATED": 0.1, "MATCH": 0.1,
}
THREATS = {
    "backdoor": ("DYNAMIC NETWORK", "IMPORT CALL ASSIGN FUNC_DEF", 0.92, [0.3, 0.3, 0.4, 1.0, 0.5, 0.0]), "data_exfiltration": ("IO NETWORK", "IMPORT CALL LOOP ASSIGN", 0.78, [0.2, 0.2, 0.2, 0.3, 1.0, 0.0]),
    "privilege_escalation": ("GLOBAL PRIVILEGE", "CALL IMPORT ASSIGN FUNC_DEF", 0.85, [0.3, 0.2, 1.0, 0.3, 0.2, 0.0]), "supply_chain": ("IMPORT CALL", "ASSIGN FUNC_DEF NETWORK", 0.71, [0.2, 1.0, 0.4, 0.5, 0.3, 0.0]),
    "obfuscation": ("DYNAMIC LAMBDA", "COMPREHENSION ASSIGN CALL", 0.80, [1.0, 0.3, 0.2, 0.5, 0.3, 0.0]), "cryptominer": ("LOOP CALL NETWORK", "IMPORT ASSIGN FUNC_DEF AWAIT", 0.68, [0.2, 0.3, 0.2, 0.4, 0.4, 0.0]),
    "credential_theft": ("IO ASSIGN", "IMPORT CALL BRANCH NETWORK", 0.82, [0.2, 0.2, 0.3, 0.4, 0.9, 0.0]), "ransomware": ("IO DELETE LOOP", "CALL IMPORT ASSIGN BRANCH", 0.95, [0.5, 0.3, 0.6, 0.7, 0.6, 0.0]),
    "process_injection": ("PRIVILEGE CALL", "IMPORT ASSIGN DYNAMIC", 0.90, [0.4, 0.2, 1.0, 0.7, 0.3, 0.0]), "safe_utility": ("", "FUNC_DEF ASSIGN RETURN BRANCH LOOP", 0.05, [0.0, 0.0, 0.0, 0.0, 0.0, 1.0]),
    "safe_webapi": ("IMPORT CALL", "FUNC_DEF ASSIGN RETURN BRANCH AWAIT", 0.08, [0.0, 0.0, 0.0, 0.0, 0.0, 1.0]), "safe_dataprocessing": ("LOOP ASSIGN", "FUNC_DEF COMPREHENSION RETURN IMPORT", 0.06, [0.0, 0.0, 0.0, 0.0, 0.0, 1.0]),
}


def node_types(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, *v) for k, v in NODE_TYPES.items()], "node_type string, ir_type string, category string, base_risk int")


def multipliers(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(MULTIPLIERS.items()), "category string, multiplier double")
