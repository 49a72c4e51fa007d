"""Fixed values of the risk contract. Times are epoch milliseconds, money is integer minor units."""

SECOND_MS = 1_000
MINUTE_MS = 60 * SECOND_MS
HOUR_MS = 60 * MINUTE_MS
DAY_MS = 24 * HOUR_MS

# --- fixed values: windows and counters -------------------------------------------------
WINDOW_60S_MS = 60_000
WINDOW_5M_MS = 300_000
WINDOW_30M_MS = 1_800_000
IDEM_TTL_MS = 24 * HOUR_MS
REPLAY_IDEM_TTL_MS = HOUR_MS
CARD_TTL_MS = 24 * HOUR_MS
SHED_TTL_MS = 60_000
CUSUM_BUCKET_S = 10
CATCHUP_BUCKETS = 17_280
RECENT_EVENTS = 200
GATEWAY_LATENCY_MS = 340
FEATURE_HORIZON_MS = WINDOW_30M_MS

# --- fixed values: the 24 model features, in order --------------------------------------
FEATURE_NAMES = (
    "attempts_per_ip_60s",
    "attempts_per_ip_5m",
    "attempts_per_ipua_5m",
    "distinct_cards_per_ip_5m_q",
    "distinct_cards_per_ipua_5m_q",
    "distinct_bins_per_ip_5m",
    "distinct_ips_per_bin_5m",
    "distinct_cards_per_bin_5m",
    "attempts_per_session",
    "card_seen_24h",
    "bin_hhi_5m",
    "bin_entropy_5m",
    "bin_is_foreign_issued",
    "foreign_bin_share_5m",
    "foreign_bin_share_sigma",
    "amount_percentile_vs_store",
    "distinct_amounts_per_ip_5m",
    "store_volume_deviation_sigma",
    "store_decline_rate_deviation_sigma",
    "decline_rate_per_ip_5m",
    "invalid_cvv_share_ip_5m",
    "outcome_coverage_ratio",
    "event_id_reuse_count",
    "clock_skew_s",
)
# Slots with no upstream feed; they hold 0.0.
UNFED_FEATURES = (
    "distinct_cards_per_ip_5m_q",
    "distinct_cards_per_ipua_5m_q",
    "bin_is_foreign_issued",
    "foreign_bin_share_5m",
    "foreign_bin_share_sigma",
    "amount_percentile_vs_store",
    "store_volume_deviation_sigma",
    "store_decline_rate_deviation_sigma",
    "decline_rate_per_ip_5m",
    "invalid_cvv_share_ip_5m",
    "outcome_coverage_ratio",
    "clock_skew_s",
)
# Features zeroed for training because one of them alone separates the classes.
EXCLUDED_FEATURES = (
    "attempts_per_ip_60s",
    "attempts_per_ip_5m",
    "attempts_per_ipua_5m",
    "distinct_ips_per_bin_5m",
    "distinct_cards_per_bin_5m",
    "distinct_amounts_per_ip_5m",
)

# --- fixed values: rules (statistic, threshold, minimum tier, evidence family) ----------
RULES = (
    ("attempts_per_ip_60s", 20, "throttle", "velocity"),
    ("distinct_cards_per_ip_5m", 15, "challenge", "velocity"),
    ("distinct_cards_per_bin_5m", 20, "challenge", "bin_structure"),
)
RULE_TEXT = {
    "attempts_per_ip_60s": "attempt volume from one IP within 60 seconds",
    "distinct_cards_per_ip_5m": "distinct cards attempted from one IP within 5 minutes",
    "distinct_cards_per_bin_5m": "distinct cards attempted against one BIN within 5 minutes",
}
NARRATIVE_CHARS = 600
NARRATIVE_PATTERN = r'^[A-Za-z0-9 ,.:%₹()\[\]{}"\n_-]+$'

# --- fixed values: tiers ----------------------------------------------------------------
TIERS = ("allow", "monitor", "throttle", "challenge", "step_up", "block")
LADDERS = {
    "domestic": ("throttle", "challenge", "block"),
    "foreign": ("throttle", "challenge", "step_up", "block"),
}
COST_TIERS = ("throttle", "challenge", "step_up", "block")

# --- fixed values: cost model -----------------------------------------------------------
COST_MODEL = {
    "auth_fee_minor": 200,
    "downstream_exposure_minor": 5_000,
    "aov_minor": 120_000,
    "margin_pct": 0.30,
    "abandonment": {"throttle": 0.01, "challenge": 0.05, "step_up": 0.15, "block": 1.00},
    "prior_steady_state": 0.001,
    "prior_under_attack": 0.9,
    "eval_prevalence": 0.01,
    "target_fpr": 0.001,
}
RIBBON_PRIORS = (1e-4, 1e-3, 1e-2)

# --- fixed values: detectors and policy -------------------------------------------------
CUSUM = {"rho": 5.0, "h": 5.0, "bucket_s": CUSUM_BUCKET_S, "lambda_min": 0.01}
DRIFT = {"exceedance_quantile": 0.95, "p1": 0.5, "alpha": 0.01, "beta": 0.05}
POLICY = {
    "hysteresis_gap": 0.08,
    "cooldown_s": 300,
    "auto_ceiling": "challenge",
    "k_max": 10,
    "control_fraction": 0.05,
    "enforcement_ttl_ms": 900_000,
    "version": 1,
}
ADMISSION = {"rate_per_s": 50, "burst": 200, "alert_threshold": 20, "alert_window_ms": 60_000}
OUTCOME_STALENESS_MS = 300_000
H_SEARCH = (0.25, 400.0)

# --- fixed values: vocabularies ---------------------------------------------------------
SCENARIOS = (
    "flash_sale",
    "corporate_nat",
    "cgnat",
    "retry_storm",
    "subscription_batch",
    "nri_traffic",
    "shared_ip_legit",
)
ENTITY_TYPES = ("ip", "ipua", "bin", "card")
STREAM_TIERS = ("easy", "medium", "hard", "evasive")
UA_TOKENS = (
    ("headless", ("headless", "phantomjs")),
    ("known_bot", ("bot", "spider", "crawler", "curl", "python-requests")),
    ("mobile_browser", ("mobile", "android", "iphone", "ipad")),
    ("desktop_browser", ("mozilla", "chrome", "safari", "firefox", "edg")),
)
QUANTILE_GRID = tuple(i / 10 for i in range(11))
PROBABILITY_EPS = 1e-6
WILSON_Z = 1.959963984540054
B1 = {"threshold": 5, "window_ms": WINDOW_60S_MS}
B2_THRESHOLD = 20
