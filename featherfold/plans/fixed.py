"""Column names, formulas' operands and aggregation specs of the credit workload.

All tables below are fixed values: they must equal the workload's definitions, or
results differ.  They are plain data; the work is done in ``credit.py``.
"""

# --- parent table -----------------------------------------------------------

# fixed values: ratio column -> (numerator, divisor)
APPLICATION_RATIOS = {
    "NEW_CREDIT_TO_ANNUITY_RATIO": ("AMT_CREDIT", "AMT_ANNUITY"),
    "NEW_CREDIT_TO_GOODS_RATIO": ("AMT_CREDIT", "AMT_GOODS_PRICE"),
    "NEW_CAR_TO_BIRTH_RATIO": ("OWN_CAR_AGE", "DAYS_BIRTH"),
    "NEW_CAR_TO_EMPLOY_RATIO": ("OWN_CAR_AGE", "DAYS_EMPLOYED"),
    "NEW_PHONE_TO_BIRTH_RATIO": ("DAYS_LAST_PHONE_CHANGE", "DAYS_BIRTH"),
    "NEW_PHONE_TO_EMPLOY_RATIO": ("DAYS_LAST_PHONE_CHANGE", "DAYS_EMPLOYED"),
    "NEW_CREDIT_TO_INCOME_RATIO": ("AMT_CREDIT", "AMT_INCOME_TOTAL"),
    "WORKING_LIFE_RATIO": ("DAYS_EMPLOYED", "DAYS_BIRTH"),
    "INCOME_PER_FAM": ("AMT_INCOME_TOTAL", "CNT_FAM_MEMBERS"),
    "CHILDREN_RATIO": ("CNT_CHILDREN", "CNT_FAM_MEMBERS"),
    "reg_div_publish": ("DAYS_REGISTRATION", "DAYS_ID_PUBLISH"),
    "birth_div_reg": ("DAYS_BIRTH", "DAYS_REGISTRATION"),
}

# fixed values: difference column -> (left, right)
APPLICATION_DIFFERENCES = {
    "credit_minus_goods": ("AMT_CREDIT", "AMT_GOODS_PRICE"),
    "OBS_30_60_diff": ("OBS_30_CNT_SOCIAL_CIRCLE", "OBS_60_CNT_SOCIAL_CIRCLE"),
    "NEW_CREDIT_TO_GOODS_DIFF": ("AMT_CREDIT", "AMT_GOODS_PRICE"),
    "AGE_REGISTRATION": ("DAYS_BIRTH", "DAYS_REGISTRATION"),
    "AGE_WORKING": ("DAYS_BIRTH", "DAYS_EMPLOYED"),
    "AGE_ID_GET": ("DAYS_BIRTH", "DAYS_ID_PUBLISH"),
    "AGE_LAST_PHONE_CHANG": ("DAYS_BIRTH", "DAYS_LAST_PHONE_CHANGE"),
}

# fixed values
EXT_SOURCES = ["EXT_SOURCE_1", "EXT_SOURCE_2", "EXT_SOURCE_3"]
DOCUMENT_FLAGS = [f"FLAG_DOCUMENT_{i}" for i in range(2, 22)]
GROUP_TEXTS = ["ORGANIZATION_TYPE", "NAME_EDUCATION_TYPE", "OCCUPATION_TYPE", "CODE_GENDER"]
GROUP_KEYS = ["ORGANIZATION_TYPE", "NAME_EDUCATION_TYPE", "AGE_RANGE", "OCCUPATION_TYPE", "CODE_GENDER"]
SAME_USER_KEYS = ["AGE_REGISTRATION", "AGE_WORKING", "AGE_ID_GET", "AGE_LAST_PHONE_CHANG"]

# fixed values: group statistic -> (column, function)
GROUP_STATISTICS = {
    "GROUP_EXT_SOURCES_MEDIAN": ("NEW_EXT_SOURCES_MEAN", "median"),
    "GROUP_EXT_SOURCES_STD": ("NEW_EXT_SOURCES_MEAN", "std"),
    "GROUP_INCOME_MEAN": ("AMT_INCOME_TOTAL", "mean"),
    "GROUP_INCOME_STD": ("AMT_INCOME_TOTAL", "std"),
    "GROUP_CREDIT_TO_ANNUITY_MEAN": ("NEW_CREDIT_TO_ANNUITY_RATIO", "mean"),
    "GROUP_CREDIT_TO_ANNUITY_STD": ("NEW_CREDIT_TO_ANNUITY_RATIO", "std"),
    "GROUP_CREDIT_MEAN": ("AMT_CREDIT", "mean"),
    "GROUP_ANNUITY_MEAN": ("AMT_ANNUITY", "mean"),
    "GROUP_ANNUITY_STD": ("AMT_ANNUITY", "std"),
}

# fixed values: cross-table ratio -> (numerator, divisor)
CROSS_TABLE_RATIOS = {
    "BUREAU_INCOME_CREDIT_RATIO": ("BURO_AMT_CREDIT_SUM_MEAN", "AMT_INCOME_TOTAL"),
    "BUREAU_ACTIVE_CREDIT_TO_INCOME_RATIO": ("BURO_ACTIVE_AMT_CREDIT_SUM_SUM", "AMT_INCOME_TOTAL"),
    "CURRENT_TO_APPROVED_CREDIT_MIN_RATIO": ("APPROVED_AMT_CREDIT_MIN", "AMT_CREDIT"),
    "CURRENT_TO_APPROVED_CREDIT_MAX_RATIO": ("APPROVED_AMT_CREDIT_MAX", "AMT_CREDIT"),
    "CURRENT_TO_APPROVED_CREDIT_MEAN_RATIO": ("APPROVED_AMT_CREDIT_MEAN", "AMT_CREDIT"),
    "CURRENT_TO_APPROVED_ANNUITY_MAX_RATIO": ("APPROVED_AMT_ANNUITY_MAX", "AMT_ANNUITY"),
    "CURRENT_TO_APPROVED_ANNUITY_MEAN_RATIO": ("APPROVED_AMT_ANNUITY_MEAN", "AMT_ANNUITY"),
    "PAYMENT_MIN_TO_ANNUITY_RATIO": ("INSTAL_AMT_PAYMENT_MIN", "AMT_ANNUITY"),
    "PAYMENT_MAX_TO_ANNUITY_RATIO": ("INSTAL_AMT_PAYMENT_MAX", "AMT_ANNUITY"),
    "PAYMENT_MEAN_TO_ANNUITY_RATIO": ("INSTAL_AMT_PAYMENT_MEAN", "AMT_ANNUITY"),
    "CTA_CREDIT_TO_ANNUITY_MAX_RATIO": ("APPROVED_CREDIT_TO_ANNUITY_RATIO_MAX", "NEW_CREDIT_TO_ANNUITY_RATIO"),
    "CTA_CREDIT_TO_ANNUITY_MEAN_RATIO": ("APPROVED_CREDIT_TO_ANNUITY_RATIO_MEAN", "NEW_CREDIT_TO_ANNUITY_RATIO"),
    "DAYS_DECISION_MEAN_TO_BIRTH": ("APPROVED_DAYS_DECISION_MEAN", "DAYS_BIRTH"),
    "DAYS_CREDIT_MEAN_TO_BIRTH": ("BURO_DAYS_CREDIT_MEAN", "DAYS_BIRTH"),
    "DAYS_DECISION_MEAN_TO_EMPLOYED": ("APPROVED_DAYS_DECISION_MEAN", "DAYS_EMPLOYED"),
    "DAYS_CREDIT_MEAN_TO_EMPLOYED": ("BURO_DAYS_CREDIT_MEAN", "DAYS_EMPLOYED"),
}

# --- bureau and its monthly balance ------------------------------------------

# fixed values
STATUS_SUM = [f"STATUS_{i}" for i in range(1, 6)]
LOAN_TYPES = {
    "Consumer credit": "BUREAU_CONSUMER_",
    "Credit card": "BUREAU_CREDIT_",
    "Mortgage": "BUREAU_MORTGAGE_",
    "Car loan": "BUREAU_CAR_",
    "Microloan": "BUREAU_MICROLOAN_",
}

# fixed values: spec of the monthly balance per loan
BALANCE_SPEC = {"MONTHS_BALANCE": ["min", "max", "mean", "size"]}

# fixed values
BUREAU_RATIOS = {
    "CREDIT_SUM_DEBT_RATIO": ("AMT_CREDIT_SUM_DEBT", "AMT_CREDIT_SUM"),
    "CREDIT_SUM_OVERDUE_RATIO": ("AMT_CREDIT_SUM_OVERDUE", "AMT_CREDIT_SUM"),
    "CREDIT_SUM_LIMIT_DEBT_RATIO": ("AMT_CREDIT_SUM_DEBT", "AMT_CREDIT_SUM_LIMIT"),
    "CREDIT_SUM_LIMIT_OVERDUE_RATIO": ("AMT_CREDIT_SUM_OVERDUE", "AMT_CREDIT_SUM_LIMIT"),
    "ANNUITY_DEBT_RATIO": ("AMT_CREDIT_SUM_DEBT", "AMT_ANNUITY"),
    "ANNUITY_OVERDUE_RATIO": ("AMT_CREDIT_SUM_OVERDUE", "AMT_ANNUITY"),
    "MAX_OVERDUE_RATIO": ("AMT_CREDIT_SUM_OVERDUE", "AMT_CREDIT_MAX_OVERDUE"),
    "CREDIT_TO_ANNUITY_RATIO": ("AMT_CREDIT_SUM", "AMT_ANNUITY"),
    "DEBT_PERCENTAGE": ("AMT_CREDIT_SUM", "AMT_CREDIT_SUM_DEBT"),
}
BUREAU_DIFFERENCES = {
    "DAYS_CREDIT_ITERVAL": ("DAYS_CREDIT", "DAYS_CREDIT_ENDDATE"),
    "ENDDATE_DIF": ("DAYS_CREDIT_ENDDATE", "DAYS_ENDDATE_FACT"),
    "DEBT_CREDIT_DIFF": ("AMT_CREDIT_SUM", "AMT_CREDIT_SUM_DEBT"),
}

# fixed values: aggregation specs, column -> functions
BUREAU_SPEC = {
    "STATUS_0": ["mean"],
    "STATUS_1": ["mean"],
    "STATUS_12345": ["mean"],
    "STATUS_X": ["mean"],
    "DAYS_CREDIT": ["min", "max", "mean", "var"],
    "DAYS_CREDIT_ENDDATE": ["min", "max", "mean"],
    "DAYS_CREDIT_UPDATE": ["mean"],
    "CREDIT_DAY_OVERDUE": ["max", "mean"],
    "AMT_CREDIT_MAX_OVERDUE": ["mean"],
    "AMT_CREDIT_SUM": ["max", "mean", "sum"],
    "AMT_CREDIT_SUM_DEBT": ["max", "mean", "sum"],
    "AMT_CREDIT_SUM_OVERDUE": ["mean"],
    "AMT_CREDIT_SUM_LIMIT": ["mean", "sum"],
    "AMT_ANNUITY": ["max", "mean"],
    "CNT_CREDIT_PROLONG": ["sum"],
    "MONTHS_BALANCE_MIN": ["min"],
    "MONTHS_BALANCE_MAX": ["max"],
    "MONTHS_BALANCE_SIZE": ["mean", "sum"],
    "DAYS_CREDIT_ITERVAL": ["min", "max", "mean", "var"],
    "CREDIT_SUM_DEBT_RATIO": ["min", "max", "mean", "var"],
    "CREDIT_SUM_OVERDUE_RATIO": ["min", "max", "mean", "var"],
    "CREDIT_SUM_LIMIT_DEBT_RATIO": ["min", "max", "mean", "var"],
    "CREDIT_SUM_LIMIT_OVERDUE_RATIO": ["min", "max", "mean", "var"],
    "ANNUITY_DEBT_RATIO": ["min", "max", "mean", "var"],
    "ANNUITY_OVERDUE_RATIO": ["min", "max", "mean", "var"],
    "MAX_OVERDUE_RATIO": ["min", "max", "mean", "var"],
    "DEBT_CREDIT_DIFF": ["mean", "sum"],
    "ENDDATE_DIF": ["mean", "sum", "max"],
}
BUREAU_ACTIVE_SPEC = {
    "DAYS_CREDIT": ["max", "mean"],
    "DAYS_CREDIT_ENDDATE": ["min", "max"],
    "AMT_CREDIT_MAX_OVERDUE": ["max", "mean"],
    "AMT_CREDIT_SUM": ["max", "sum"],
    "AMT_CREDIT_SUM_DEBT": ["mean", "sum"],
    "AMT_CREDIT_SUM_OVERDUE": ["max", "mean"],
    "DAYS_CREDIT_UPDATE": ["min", "mean"],
    "DEBT_PERCENTAGE": ["mean"],
    "DEBT_CREDIT_DIFF": ["mean"],
    "CREDIT_TO_ANNUITY_RATIO": ["mean"],
    "MONTHS_BALANCE_MEAN": ["mean", "var"],
    "MONTHS_BALANCE_SIZE": ["mean", "sum"],
}
BUREAU_CLOSED_SPEC = {
    "DAYS_CREDIT": ["max", "var"],
    "DAYS_CREDIT_ENDDATE": ["max"],
    "AMT_CREDIT_MAX_OVERDUE": ["max", "mean"],
    "AMT_CREDIT_SUM_OVERDUE": ["mean"],
    "AMT_CREDIT_SUM": ["max", "mean", "sum"],
    "AMT_CREDIT_SUM_DEBT": ["max", "sum"],
    "DAYS_CREDIT_UPDATE": ["max"],
    "ENDDATE_DIF": ["mean"],
    "STATUS_12345": ["mean"],
}
BUREAU_TYPE_SPEC = {
    "DAYS_CREDIT": ["mean", "max"],
    "AMT_CREDIT_MAX_OVERDUE": ["mean", "max"],
    "AMT_CREDIT_SUM": ["mean", "max"],
    "AMT_CREDIT_SUM_DEBT": ["mean", "max"],
    "DEBT_PERCENTAGE": ["mean"],
    "DEBT_CREDIT_DIFF": ["mean"],
    "DAYS_CREDIT_ENDDATE": ["max"],
}
BUREAU_RECENT_SPEC = {
    "AMT_CREDIT_MAX_OVERDUE": ["max", "mean"],
    "AMT_CREDIT_SUM_OVERDUE": ["mean"],
    "AMT_CREDIT_SUM": ["max", "sum"],
    "AMT_CREDIT_SUM_DEBT": ["mean", "sum"],
    "DEBT_PERCENTAGE": ["mean"],
    "DEBT_CREDIT_DIFF": ["mean"],
    "STATUS_0": ["mean"],
    "STATUS_12345": ["mean"],
}
# fixed values: ratios of the aggregates
BUREAU_TOTAL_RATIOS = {
    "BURO_DEBT_OVER_CREDIT": ("BURO_AMT_CREDIT_SUM_DEBT_SUM", "BURO_AMT_CREDIT_SUM_SUM"),
    "BURO_ACTIVE_DEBT_OVER_CREDIT": ("BURO_ACTIVE_AMT_CREDIT_SUM_DEBT_SUM", "BURO_ACTIVE_AMT_CREDIT_SUM_SUM"),
}

# --- previous applications ---------------------------------------------------

# fixed values
UNKNOWN_DAY = 365243
PREVIOUS_DAY_COLUMNS = [
    "DAYS_FIRST_DRAWING", "DAYS_FIRST_DUE", "DAYS_LAST_DUE_1ST_VERSION", "DAYS_LAST_DUE", "DAYS_TERMINATION",
]
PREVIOUS_RATIOS = {
    "APP_CREDIT_PERC": ("AMT_APPLICATION", "AMT_CREDIT"),
    "INTREST_RATE_RATIO": ("RATE_INTEREST_PRIVILEGED", "RATE_INTEREST_PRIMARY"),
    "CREDIT_TO_GOODS_RATIO": ("AMT_CREDIT", "AMT_GOODS_PRICE"),
    "CREDIT_TO_ANNUITY_RATIO": ("AMT_CREDIT", "AMT_ANNUITY"),
}
PREVIOUS_DIFFERENCES = {
    "APP_CREDIT_DIFF": ("AMT_APPLICATION", "AMT_CREDIT"),
    "APP_DURATION": ("DAYS_TERMINATION", "DAYS_DECISION"),
    "APP_PAY_DURATION": ("DAYS_LAST_DUE", "DAYS_FIRST_DRAWING"),
}
PREVIOUS_SPEC = {
    "AMT_ANNUITY": ["min", "max", "mean"],
    "AMT_APPLICATION": ["min", "max", "mean"],
    "AMT_CREDIT": ["min", "max", "mean"],
    "APP_CREDIT_PERC": ["min", "max", "mean", "var"],
    "APP_CREDIT_DIFF": ["min", "max", "mean", "var"],
    "AMT_DOWN_PAYMENT": ["min", "max", "mean"],
    "AMT_GOODS_PRICE": ["min", "max", "mean"],
    "HOUR_APPR_PROCESS_START": ["min", "max", "mean"],
    "RATE_DOWN_PAYMENT": ["min", "max", "mean"],
    "DAYS_DECISION": ["min", "max", "mean"],
    "CNT_PAYMENT": ["mean", "sum"],
    "APP_DURATION": ["max", "mean", "sum"],
    "APP_PAY_DURATION": ["max", "mean", "sum"],
    "INTREST_RATE_RATIO": ["max", "mean", "sum", "var"],
    "CREDIT_TO_GOODS_RATIO": ["max", "mean", "sum", "var"],
    "CREDIT_TO_ANNUITY_RATIO": ["mean", "max"],
    "SIMPLE_INTERESTS": ["max", "mean"],
}
PREVIOUS_RECENT_SPEC = {
    "AMT_CREDIT": ["sum"],
    "AMT_ANNUITY": ["mean", "max"],
    "SIMPLE_INTERESTS": ["mean", "max"],
    "DAYS_DECISION": ["min", "mean"],
    "DAYS_LAST_DUE_1ST_VERSION": ["min", "max", "mean"],
    "APP_CREDIT_DIFF": ["min"],
    "APP_CREDIT_PERC": ["min", "max", "mean"],
    "NAME_CONTRACT_TYPE_Consumer loans": ["mean"],
    "NAME_CONTRACT_TYPE_Cash loans": ["mean"],
    "NAME_CONTRACT_TYPE_Revolving loans": ["mean"],
}

# --- instalments --------------------------------------------------------------

# fixed values
INSTALMENT_SPEC = {
    "NUM_INSTALMENT_VERSION": ["nunique"],
    "DAYS_ENTRY_PAYMENT": ["min", "max", "mean"],
    "DPD": ["max", "mean", "sum"],
    "DBD": ["max", "mean", "sum"],
    "PAYMENT_PERC": ["max", "mean", "var"],
    "PAYMENT_DIFF": ["max", "mean", "sum", "var"],
    "AMT_INSTALMENT": ["max", "mean", "sum"],
    "AMT_PAYMENT": ["min", "max", "mean", "sum"],
    "SK_ID_PREV": ["size", "nunique"],
    "LATE_PAYMENT": ["mean", "sum"],
    "SIGNIFICANT_LATE_PAYMENT": ["mean", "sum"],
    "LATE_PAYMENT_RATIO": ["mean"],
    "DPD_7": ["mean"],
    "DPD_15": ["mean"],
}
INSTALMENT_RECENT_SPEC = {
    "SK_ID_PREV": ["size"],
    "DAYS_ENTRY_PAYMENT": ["min", "max", "mean"],
    "AMT_INSTALMENT": ["min", "max", "mean", "sum"],
    "AMT_PAYMENT": ["min", "max", "mean", "sum"],
    "DPD": ["max", "mean", "var"],
    "DBD": ["max", "mean", "var"],
    "PAYMENT_DIFF": ["mean"],
    "PAYMENT_PERC": ["mean"],
    "LATE_PAYMENT": ["mean"],
    "SIGNIFICANT_LATE_PAYMENT": ["mean"],
    "LATE_PAYMENT_RATIO": ["mean"],
    "DPD_7": ["mean"],
    "DPD_15": ["mean"],
}

# --- monthly cash balances ----------------------------------------------------

# fixed values
CASH_RATIOS = {"INSTALMENT_FUTURE_RATIO": ("CNT_INSTALMENT_FUTURE", "CNT_INSTALMENT")}
CASH_SPEC = {
    "MONTHS_BALANCE": ["max", "mean", "size"],
    "SK_DPD": ["max", "mean"],
    "SK_DPD_DEF": ["max", "mean"],
    "CNT_INSTALMENT": ["max", "first", "last", "mean", "sum", "var"],
    "CNT_INSTALMENT_FUTURE": ["max", "mean", "sum", "var", "last"],
    "INSTALMENT_FUTURE_RATIO": ["max", "mean", "sum", "var"],
    "INSTALMENT_BALANCE_RATIO": ["max", "mean", "sum", "var"],
    "NAME_CONTRACT_STATUS_Completed": ["mean"],
}

# --- monthly card balances ----------------------------------------------------

# fixed values
CARD_RATIOS = {
    "POS_AMT_MEAN": ("AMT_DRAWINGS_POS_CURRENT", "CNT_DRAWINGS_POS_CURRENT"),
    "LIMIT_USE": ("AMT_BALANCE", "AMT_CREDIT_LIMIT_ACTUAL"),
    "PAYMENT_DIV_MIN": ("AMT_PAYMENT_CURRENT", "AMT_INST_MIN_REGULARITY"),
    "DRAWING_LIMIT_RATIO": ("AMT_DRAWINGS_ATM_CURRENT", "AMT_CREDIT_LIMIT_ACTUAL"),
}
CARD_DIFFERENCES = {
    "PAYMENT_DIFF": ("AMT_PAYMENT_CURRENT", "AMT_PAYMENT_TOTAL_CURRENT"),
    "RECEIVABLE_DIFF": ("AMT_TOTAL_RECEIVABLE", "AMT_RECIVABLE"),
    "RECEIVABLE_PRINCIPAL_DIFF": ("AMT_TOTAL_RECEIVABLE", "AMT_RECEIVABLE_PRINCIPAL"),
}
CARD_DRAWINGS = ["CNT_DRAWINGS_ATM_CURRENT", "CNT_DRAWINGS_OTHER_CURRENT", "CNT_DRAWINGS_POS_CURRENT"]
CARD_SPEC = {
    "MONTHS_BALANCE": ["max", "mean", "min"],
    "AMT_BALANCE": ["max", "mean", "sum", "var"],
    "AMT_CREDIT_LIMIT_ACTUAL": ["max", "mean", "var"],
    "AMT_DRAWINGS_ATM_CURRENT": ["max", "mean", "sum", "var"],
    "AMT_DRAWINGS_CURRENT": ["max", "mean", "sum", "var"],
    "AMT_DRAWINGS_OTHER_CURRENT": ["max", "mean", "sum", "var"],
    "AMT_DRAWINGS_POS_CURRENT": ["max", "mean", "sum", "var"],
    "AMT_INST_MIN_REGULARITY": ["max", "mean", "sum", "var"],
    "AMT_PAYMENT_CURRENT": ["max", "mean", "sum", "var"],
    "AMT_PAYMENT_TOTAL_CURRENT": ["max", "mean", "sum", "var"],
    "AMT_RECEIVABLE_PRINCIPAL": ["max", "mean", "sum", "var"],
    "AMT_RECIVABLE": ["max", "mean", "sum", "var"],
    "AMT_TOTAL_RECEIVABLE": ["max", "mean", "var"],
    "CNT_DRAWINGS_ATM_CURRENT": ["max", "mean", "sum", "var"],
    "CNT_DRAWINGS_CURRENT": ["max", "mean", "sum", "var"],
    "CNT_DRAWINGS_OTHER_CURRENT": ["max", "mean", "sum", "var"],
    "CNT_DRAWINGS_POS_CURRENT": ["max", "mean", "sum", "var"],
    "CNT_INSTALMENT_MATURE_CUM": ["max", "mean", "sum", "var"],
    "SK_DPD": ["max", "mean"],
    "SK_DPD_DEF": ["max", "mean"],
    "INSTALMENT_MATURE_BALANCE_RATIO": ["max", "mean", "var"],
    "POS_AMT_MEAN": ["max", "mean", "sum", "var"],
    "PAYMENT_DIFF": ["max", "mean", "sum", "var"],
    "RECEIVABLE_DIFF": ["max", "mean", "sum", "var"],
    "RECEIVABLE_PRINCIPAL_DIFF": ["max", "mean", "sum", "var"],
    "LIMIT_USE": ["max", "mean"],
    "PAYMENT_DIV_MIN": ["min", "mean"],
    "LATE_PAYMENT": ["max", "sum"],
}
CARD_RELATIVE_FUNCTIONS = ["max", "mean", "sum", "var"]
CARD_LAST_SPEC = {"AMT_BALANCE": ["mean", "max"]}
CARD_RECENT_SPEC = {
    "CNT_DRAWINGS_ATM_CURRENT": ["mean"],
    "SK_DPD": ["max", "sum"],
    "AMT_BALANCE": ["mean", "max"],
    "LIMIT_USE": ["max", "mean"],
}

# fixed values: weights of the five-model blend
BLEND_WEIGHTS = {"LGB": 0.45, "XG": 0.45, "CB": 0.03, "ET": 0.02, "RF": 0.05}
