"""Fixed domain values of the modelled business.

FIXED VALUES — these must equal the modelled product's categories exactly (they are
matched by the marts, the dashboards and the accepted-values rules). Natural order.
"""

# --- fixed values -------------------------------------------------------------------
SEGMENTS = ["Enterprise", "Mid-Market", "SMB"]
REGIONS = ["North America", "EMEA", "APAC", "LATAM"]
MARKETING_CHANNELS = ["Google Ads", "LinkedIn", "Content Marketing", "Events", "Referral"]
PLAN_TIERS = ["Starter", "Professional", "Business", "Enterprise"]
SUPPORT_CATEGORIES = ["Technical", "Billing", "Feature Request", "Bug Report"]
SEVERITIES = ["Low", "Medium", "High", "Critical"]
COMPANY_SIZES = ["1-50", "51-200", "201-1000", "1000+"]
USER_ROLES = ["Admin", "User", "Viewer"]
PAYMENT_METHODS = ["Credit Card", "ACH", "Wire Transfer"]
ACCOUNT_STATUSES = ["Active", "Inactive"]
SUBSCRIPTION_STATUSES = ["Active", "Cancelled"]
INVOICE_STATUSES = ["Paid", "Pending", "Failed"]
DEAL_STAGES = ["Lead", "MQL", "SQL", "Proposal", "Negotiation", "Closed Won", "Closed Lost"]
EVENT_TYPES = ["login", "feature_use", "activation", "weekly_active"]
ANOMALY_TYPES = ["Spike", "Drop", "Normal"]
ANOMALY_SEVERITIES = ["High Change", "Moderate Change", "Normal"]
METRIC_NAMES = ["MRR", "Churned MRR", "New MRR"]
# --- end of fixed values ------------------------------------------------------------

CLOSED_STAGES = ["Closed Won", "Closed Lost"]
