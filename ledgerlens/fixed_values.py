"""Words, lookup tables and texts that results must carry unchanged.

Everything here is data. The texts are shown to ledger users and are kept in their language.
"""

# Status words that may stand in a cell instead of an amount.
STATUS_TOKENS = ("FULL", "PM", "GRAHA", "SCRUB", "LELANG", "KURAS")

# Month words in sheet names.
SHEET_MONTHS = {
    "JANUARI": 1, "FEBUARI": 2, "FEBRUARI": 2, "MARET": 3, "APRIL": 4, "MEI": 5, "MAY": 5,
    "JUNI": 6, "JULI": 7, "AGUSTUS": 8, "SEPTEMBER": 9, "OKTOBER": 10, "NOVEMBER": 11,
    "NOPEMBER": 11, "DESEMBER": 12,
}

# Month names in reports.
MONTH_NAMES = {
    1: "Januari", 2: "Februari", 3: "Maret", 4: "April", 5: "Mei", 6: "Juni",
    7: "Juli", 8: "Agustus", 9: "September", 10: "Oktober", 11: "November", 12: "Desember",
}

# Section titles in a sheet and their category; the first match wins.
TOTALS_SECTION = "__TOTALS__"
STACKED_SECTION = "BUS_ELF"
STACKED_LABELS = ("BUS", "ELF")
SECTION_TITLES = (
    ("PEMAKAIAN SOLAR RTGC", "RTGC"),
    ("PEMAKAIAN SOLAR HEADTRUCK", "HEAD_TRUCK"),
    ("PEMAKAIAN SOLAR SL", "SUPPORT"),
    ("PEMAKAIAN SOLAR SITE LOADER", "SUPPORT"),
    ("PEMAKAIAN SOLAR RICHT STAGGER", "SUPPORT"),
    ("PEMAKAIAN SOLAR REACH STACKER", "SUPPORT"),
    ("PEMAKAIAN SOLAR FORKLIF", "SUPPORT"),
    ("PEMAKAIAN SOLAR COMPRESOR", "COMPRESSOR"),
    ("PEMAKAIAN SOLAR KOMPRESOR", "COMPRESSOR"),
    ("PEMAKAIAN SOLAR KENDARAAN OPERATIONAL", "KEND_OPS"),
    ("PEMAKAIAN SOLAR KENDARAAN BUS DAN ELF", STACKED_SECTION),
    ("PEMAKAIAN SOLAR KENDARAAN BUS", "BUS"),
    ("PEMAKAIAN SOLAR KENDARAAN ELF", "ELF"),
    ("PEMAKAIAN SOLAR MODUL", "MODUL"),
    ("TOTALISATOR", TOTALS_SECTION),
)
GRAND_TOTAL = "GRAND_TOTAL"

# Labels of control totals for each category.
CATEGORY_LABELS = {
    "RTGC": ["RTGC"],
    "HEAD_TRUCK": ["HEAD TRUCK", "HEAD TRUK"],
    "SUPPORT": ["SL/RS/FRK", "SITE LOADER", "RIGTH STAGGER", "RICHT STAGGER", "REACH STACKER", "FORKLIF"],
    "KEND_OPS": ["KEND OP", "KEND OPS"],
    "BUS": ["BUS"],
    "ELF": ["ELF"],
    "MODUL": ["MODUL"],
    "COMPRESSOR": ["COMP MEANTENAN", "COMP MEANTENANT", "COMPRESOR", "KOMPRESOR"],
}

# Unit prefixes in vendor reports.
UNIT_PREFIXES = {"HT": "HEAD_TRUCK", "BUS": "BUS"}

# Issue codes by row status, and their descriptions.
ISSUE_CODES = {
    "INVALID_DATE": "INV_DATE_001",
    "NEGATIVE_VALUE": "NEG_VAL_001",
    "DUPLICATE": "DUP_001",
    "UNUSUALLY_HIGH": "HIGH_VAL_001",
    "UNKNOWN_STATUS": "UNK_STAT_001",
    "MISSING": "MISS_001",
}
ISSUE_TEXTS = {
    "INV_DATE_001": "Tanggal tidak valid (kemungkinan kolom hari ikut ter-copy dari bulan lain, mis. tanggal 30/31 Februari)",
    "NEG_VAL_001": "Nilai liter negatif -- tidak masuk akal secara fisik, kemungkinan salah input",
    "DUP_001": "Transaksi duplikat: kombinasi (tanggal, kategori, equipment_id) muncul lebih dari sekali",
    "HIGH_VAL_001": "Nilai liter tidak wajar tinggi dibanding pola historis kategori yang sama (ambang IQR)",
    "UNK_STAT_001": "Teks status pada sel tidak dikenali (bukan FULL/PM/GRAHA/SCRUB/LELANG/KURAS)",
    "MISS_001": "Nilai liter kosong tanpa status yang jelas",
}
MISSING_DAY = "NO_TRANSACTION_RECORDED_THIS_DAY"

# Severities in rising order; the position is the weight in the health score.
SEVERITIES = ("NORMAL", "LOW", "MEDIUM", "HIGH", "CRITICAL")
MAD_SCALE = 0.6744897501960817

# Anomaly types and the text given for each.
ANOMALY_TEXTS = {
    "NORMAL": "Konsumsi berada dalam pola normal unit.",
    "UNUSUAL_ZERO_FILL": "Pengisian tercatat nol liter -- tidak biasa dibanding transaksi lain unit ini.",
    "HIGH_VS_OWN_PATTERN": "Konsumsi jauh di atas pola normal unit ini (dibanding riwayat transaksinya sendiri).",
    "LOW_VS_OWN_PATTERN": "Konsumsi jauh di bawah pola normal unit ini.",
    "SPIKE_VS_PREVIOUS": "Lonjakan/penurunan besar dibanding transaksi sebelumnya.",
    "EXTREME_VS_CATEGORY_PEERS": "Berbeda ekstrem dibanding median alat sejenis pada kategori yang sama.",
    "MULTIVARIATE_OUTLIER": "Kombinasi pola (nilai, hari, bulan) terdeteksi sebagai outlier oleh Isolation Forest.",
    "STATISTICAL_DEVIATION": "Terdeteksi menyimpang secara statistik dari pola historis unit.",
}
TOO_FEW_TEXT = "Observasi (%d) di bawah ambang minimum (%d) -- belum layak dianalisis."

# Peer comparison states.
PEER_HIGH = "Menyimpang Tinggi"
PEER_LOW = "Menyimpang Rendah"
PEER_NONE = "Tidak Ada Transaksi"
PEER_NORMAL = "Normal"

# Weights of change directions and confidences, penalties of reconciliation states.
DIRECTION_WEIGHTS = {
    "INCREASE": 1.0, "VOLATILITY_INCREASE": 0.8, "DECREASE": 0.4, "VOLATILITY_DECREASE": 0.3, "MINOR_SHIFT": 0.2,
}
CONFIDENCE_WEIGHTS = {"HIGH": 1.0, "MEDIUM": 0.6, "LOW": 0.3}
RECONCILIATION_PENALTIES = {
    "MATCH": 0.0, "MINOR DIFFERENCE": 20.0, "MAJOR DIFFERENCE": 60.0, "REQUIRES REVIEW": 100.0,
    "NO_WORKBOOK_VALUE": 0.0,
}
PROBLEM_STATES = ("MAJOR DIFFERENCE", "REQUIRES REVIEW")

# Weights of the health score and its bands (both ends included; between bands: REVIEW).
HEALTH_WEIGHTS = {
    "anomaly_penalty": 0.20, "volatility_penalty": 0.15, "trend_penalty": 0.15, "change_point_penalty": 0.15,
    "missing_data_penalty": 0.10, "reconciliation_penalty": 0.10, "forecast_error_penalty": 0.05,
    "repeated_critical_penalty": 0.10,
}
HEALTH_BANDS = {"HEALTHY": (85, 100), "MONITOR": (70, 84), "REVIEW": (50, 69), "CRITICAL": (0, 49)}

# Actions shown beside a health score.
ACTION_COLLECT = "Kumpulkan lebih banyak data sebelum dievaluasi"
ACTION_RECONCILE = "Validasi data pengisian (selisih rekonsiliasi kategori signifikan)"
ACTION_INSPECT = "Koordinasikan inspeksi alat (anomali kritis berulang)"
ACTION_COMPARE = "Bandingkan dengan hour meter dan log operasi (perubahan pola menetap terdeteksi)"
ACTION_LOGS = "Periksa log operasi"
ACTION_GAPS = "Cek kemungkinan duplikasi transaksi / konfirmasi status alat"
ACTION_WATCH = "Monitor tujuh hari berikutnya"
ACTION_NONE = "Tidak ada tindakan"

# Segment texts.
SEGMENT_FORMAT = "mean~%.0fL, CV~%.2f, active_ratio~%.2f, growth~%.1f%%/bulan"
SEGMENT_TOO_FEW = "Observasi terlalu sedikit untuk disegmentasi"

# Forecast model names and texts.
FORECAST_MODELS = {
    "naive": "Naive (nilai hari terakhir)",
    "seasonal_naive_7": "Seasonal Naive (7 hari)",
    "moving_average_7": "Moving Average 7 Hari",
    "moving_average_30": "Moving Average 30 Hari",
    "holt_winters": "Holt-Winters (Exponential Smoothing)",
    "random_forest": "Random Forest",
    "hist_gradient_boosting": "HistGradientBoosting",
}
PLACEHOLDER_MODEL = "PLACEHOLDER_SEASONAL_NAIVE_7"

# Scenarios and their share of the saving target.
SCENARIO_BAU = "Business as Usual"
SCENARIO_MODERATE = "Moderate Saving"
SCENARIO_TARGET = "Target Saving"

# Recommendation priorities (rank order, days to the target date), roles and texts.
PRIORITY_DAYS = {"HIGH": 7, "MEDIUM": 14, "LOW": 30}
ROLE_OPERATIONS = "Operations Admin"
ROLE_EQUIPMENT = "Equipment"
ROLE_MAINTENANCE = "Maintenance"
ROLE_FUEL = "Fuel Administration"
ROLE_SUPERVISOR = "Supervisor"
ROLE_DATA = "ICT/Data Team"
FLEET_UNIT = "ARMADA (seluruh alat)"
FLEET_CATEGORY = "ALL"
ALL_UNITS_FORMAT = "SEMUA UNIT (%s)"
FINDING_CRITICAL = "Health score rendah, disertai anomali kritis berulang dan tren konsumsi naik."
FINDING_INCOMPLETE = "Jumlah anomali cukup tinggi, namun kelengkapan data unit ini rendah."
FINDING_BUDGET = "Proyeksi konsumsi Business-as-Usual melebihi target penghematan tahunan."
FINDING_MEDIAN = "Rata-rata konsumsi per pengisian jauh di atas median unit sejenis."
FINDING_RECONCILE = "Selisih rekonsiliasi signifikan pada kategori %s untuk bulan: %s."
FINDING_CHANGE = "Perubahan pola konsumsi yang menetap terdeteksi (bukan sekadar lonjakan sesaat)."
FINDING_GAP = "Terdapat jeda panjang tanpa transaksi solar di tengah masa aktif unit."
EVIDENCE_CRITICAL = "health_score=%.1f, critical_anomaly_count=%d, trend_percentage=%.1f%%"
EVIDENCE_INCOMPLETE = "anomaly_count=%d, data_completeness=%.1f%%"
EVIDENCE_BUDGET = "gap_to_target=%s L, required_daily_reduction=%s L/hari"
EVIDENCE_MEDIAN = "average_daily_fuel=%.1f L vs median kategori %.1f L (rasio %.2fx)"
EVIDENCE_RECONCILE = "n_bulan_bermasalah=%d, max_diff_pct=%.1f%%"
EVIDENCE_CHANGE = "change_point_penalty=%.1f, last_change_point=%s"
EVIDENCE_GAP = "missing_data_penalty=%.1f, data_completeness=%.1f%%"
DO_CRITICAL = "Prioritas tinggi untuk validasi data dan inspeksi operasional."
DO_INCOMPLETE = "Validasi kualitas data sebelum menyimpulkan kondisi unit."
DO_BUDGET = "Diperlukan pengurangan rata-rata %s liter per hari untuk mencapai target penghematan tahunan."
DO_MEDIAN = "Bandingkan jam operasi, trip, idle time, dan hour meter dengan unit sejenis."
DO_RECONCILE = "Verifikasi pencatatan pengisian solar kategori ini pada bulan terkait sebelum dipakai untuk kesimpulan operasional."
DO_CHANGE = "Bandingkan dengan hour meter dan log operasi unit ini di sekitar tanggal perubahan."
DO_GAP = "Cek kemungkinan duplikasi transaksi / konfirmasi status alat (aktif, dipindah, atau nonaktif)."
