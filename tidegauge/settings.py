"""Values the operators take as defaults; every operator accepts others as arguments."""

# They decide the results and must not change.
BATCH_INTERVAL_SEC = 5
TCP_BATCH_INTERVAL_SEC = 1
FILE_REPORT_SEC = 3
TCP_REPORT_SEC = 5
RETENTION_SEC = 60
REMEMBER_SEC = 60
MESSAGE_SIZES = [500, 1000, 10000, 100000, 1000000, 5000000, 10000000, 50000000]
DEFAULT_PARAMS = {"cpu_pause_ms": 20, "message_bytes": 200, "period_sec": 1.0}
HIDDEN_PREFIX = "."
IN_PROGRESS_PREFIX = ".COPYING."
LOG_TAIL_LINES = 500
PREVIEW_ROWS = 10
LISTING_LOGGER = "FileInputDStream"
LISTING_TEXT = "Finding new files took"
APP_LOGGER = "file-streaming-app"
LIMIT_FILE_LISTING = "LIMIT_FILE_LISTNG"  # this spelling appears in outputs
LIMIT_TOTAL_DELAY = "LIMIT_TOTAL_DELAY"
RUN_STAMP_FORMAT = "%Y_%m_%d__%H_%M_%S"

# Our own fixed padding; message content carries no meaning.
PADDING = "abcdefghijklmnopqrstuvwxyz0123456789"

# Telemetry this close to a change of rate still shows the old rate.
WARMUP_SEC = 3 + 2 * BATCH_INTERVAL_SEC

# A listing slower than 95 % of a batch is slow.
SLOW_LISTING_MS = 4750
