"""Fixed values. They must stay as they are for results to match; nothing here is logic."""

# --- fixed values: redaction and normalization patterns (Java regex) ---------------------------
MASK = "***"
SECRET_PATTERNS = [
    r'(?i)(authorization\s*[:=]\s*)?bearer\s+[^\s",;)]+',
    r'(?i)(password|passwd|pwd|token|secret|api[_-]?key|authorization)\s*[:=]\s*"?[^\s",;)]+"?',
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}",
    r"(?<!\d)1[3-9]\d{9}(?!\d)",
    r"(?<!\d)\d{17}[\dXx](?!\d)",
]
# What a text needs for the last two patterns to match.
LONG_NUMBER = r"\d{11}"
SENSITIVE_KEY = (
    r"(?i)(pass(word|wd)?|pwd|token|secret|api[_-]?key|authorization|credential|access[_-]?key)"
)
# A word edge spelled out, because the meaning of \b for non-ASCII letters changed between JDKs.
NO_WORD_BEFORE = r"(?<![\p{L}\p{Nd}\p{Mn}_])"
NO_WORD_AFTER = r"(?![\p{L}\p{Nd}\p{Mn}_])"
UUID = r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}"
ISO_TIMESTAMP = r"\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:Z|[+-]\d{2}:?\d{2})?"
IPV4 = NO_WORD_BEFORE + r"\d{1,3}(?:\.\d{1,3}){3}" + NO_WORD_AFTER
LONG_HEX = NO_WORD_BEFORE + r"[0-9a-fA-F]{16,}" + NO_WORD_AFTER
NUMBER = NO_WORD_BEFORE + r"\d+" + NO_WORD_AFTER
TEMPLATE_PATTERNS = [
    (UUID, "{uuid}"),
    (ISO_TIMESTAMP, "{ts}"),
    (IPV4, "{ip}"),
    (LONG_HEX, "{hex}"),
    (NUMBER, "{n}"),
]
# What a match begins with; looked for first, it spares the slow part of a pattern at most places.
BEGINS_WITH = {
    SECRET_PATTERNS[0]: "[abAB][ueUE]", IPV4: r"\d{1,3}\.\d", LONG_HEX: "[0-9a-fA-F]{16}", NUMBER: r"\d",
}
# The same matches, searched faster: secret words by their first two letters, addresses only where a run of such characters
# begins or the last match ended.
SEARCHED_AS = {
    SECRET_PATTERNS[1]: (
        r"[pastPAST][awoepuAWOEPU](?i)(?:(?<=pa)ss(?:word|wd)|(?<=pw)d|(?<=to)ken|(?<=se)cret|(?<=ap)i[_-]?key|(?<=au)thorization)"
        r'\s*[:=]\s*"?[^\s",;)]+"?'),
    SECRET_PATTERNS[2]: r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9.-]+\.[A-Za-z]{2,}",
}
THROWABLE = r"\b([\w$.]+(?:Exception|Error))\b"

# --- fixed values: log line layout --------------------------------------------------------------
ANSI_ESCAPE = r"\x1b\[[0-9;]*m"
DEFAULT_LINE_PATTERN = (
    r"^(?<ts>\d{4}-\d{2}-\d{2}[ T]\d{2}:\d{2}:\d{2}[.,]\d{3}(?:Z|[+-]\d{2}:?\d{2})?)\s+"
    r"(?<level>TRACE|DEBUG|INFO|WARN|ERROR)\s+"
    r"(?:\d+\s+)?"
    r"(?:---\s+)?"
    r"(?:\[(?<thread>[^\]]+)\]\s+)?"
    r"(?<logger>[\w$.-]+)\s*[-:]\s*"
    r"(?<msg>.*)$"
)
KEPT_LEVELS = ["WARN", "ERROR"]
TABLE_NAME_PART = r"[A-Za-z_][A-Za-z0-9_]{0,63}"

# --- fixed values: limits and windows -----------------------------------------------------------
ELLIPSIS = "…"
MAX_SAMPLE_CHARS = 1200
MAX_STACK_LINES = 12
MAX_EVENT_LINES = 100
MAX_EVENT_CHARS = 16 * 1024
LONG_TRANSACTION_SECONDS = 30
HISTORY_DEFAULT_LIMIT = 50
HISTORY_MAX_LIMIT = 200
BATCH_MAX_AGE_SECONDS = 5 * 60
BATCH_MAX_BYTES = 1024 * 1024
BATCH_EVENT_MAX_BYTES = 16 * 1024
BATCH_MAX_EVENTS = 1_000_000
BATCH_REPEAT_WINDOW = "15 minutes"
CURRENT_WINDOW_SECONDS = 10 * 60
DEPLOY_BACKWARD_SECONDS = 10 * 60
DEPLOY_FORWARD_SECONDS = 60 * 60
SQL_METRIC_WINDOW_SECONDS = 10 * 60
SPIKE_ABSOLUTE = 5
SPIKE_RATIO = 3.0
BUDGET_CLUSTERS = 20
BUDGET_SLOW_SQL = 15
BUDGET_METRICS = 20
BUDGET_CHANGES = 20

# --- fixed values: labels and report texts ------------------------------------------------------
DEPLOYMENT_TYPES = ["DEPLOYMENT", "ROLLBACK"]
DEPLOYMENT_REGRESSION = "deployment-regression"
POOL_CONTENTION = "slow-sql-pool-contention"
LATENCY_CORRELATION = "slow-sql-latency-correlation"
CANDIDATE_TITLES = {
    DEPLOYMENT_REGRESSION: "发布后引入异常",
    POOL_CONTENTION: "慢 SQL 导致连接池等待",
    LATENCY_CORRELATION: "慢 SQL 与接口延迟时间相关",
}
EXPLANATIONS = {
    DEPLOYMENT_REGRESSION: "异常突增的时间窗口紧跟在一次发布之后,提示新版本可能引入了缺陷。",
    POOL_CONTENTION: "高耗时 SQL 与连接池等待同时出现,慢查询占用连接,导致接口整体变慢。",
    LATENCY_CORRELATION: "高耗时 SQL 与接口延迟在时间上相关,但当前证据不足以确认因果关系。",
}
DEFAULT_EXPLANATION = "依据规则聚合的证据得出的候选解释。"
ACTIONS = {
    DEPLOYMENT_REGRESSION: [
        "核对发布版本对应的提交,定位空值处理改动。",
        "人工评估是否回滚到上一个稳定版本。",
    ],
    POOL_CONTENTION: [
        "人工运行 EXPLAIN 评估该 SQL 模板的索引情况。",
        "检查连接池容量与慢查询是否需要分离读负载。",
    ],
    LATENCY_CORRELATION: [
        "人工运行 EXPLAIN 评估该 SQL 模板的索引情况。",
        "补充连接池指标或 traceId,进一步验证慢 SQL 与接口延迟的因果关系。",
    ],
}
REVIEW_ACTION = "结合时间线与证据进行人工复核。"
WIDEN_ACTION = "扩大时间范围或接入更多证据源后重试诊断。"
FALLBACK_SUMMARY_EMPTY = "模型不可用,且规则未识别出明确根因。已返回聚合证据与时间线供人工排查。"
FALLBACK_SUMMARY = "模型不可用,以下为规则分析得出的候选根因(降级报告)。"
NO_DATABASE = "no database configured"
DISCLAIMER = "AI 生成的排障建议,仅供人工核验。请在执行任何变更前复查证据。"
SPIKE_PREFIX = "异常突增: "
PLAIN_PREFIX = "异常: "
SPIKE_EVIDENCE_PREFIX = "突增 "
TIMES = " ×"
SLOW_SQL_PREFIX = "慢 SQL avg="
HEALTH_PREFIX = "连接 active="
LONG_TRANSACTIONS_PART = "; 长事务 "
LOCK_WAITS_PART = "; 锁等待 "
NO_CAUSE_SUMMARY = ["未发现明确根因。已聚合 ", " 类日志与 ", " 条时间线证据,建议人工进一步排查。"]
TOP_CAUSE_SUMMARY = ["最可能的原因是", "(证据强度 ", ")。详见根因候选与时间线。"]
