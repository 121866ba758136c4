"""Word lists, patterns, limits and sentences that results depend on."""

from __future__ import annotations

# Keywords scored per document type; earlier types win ties.
TYPE_KEYWORDS = {
    "invoice": ["invoice", "bill", "receipt", "payment", "due date", "invoice number", "total amount"],
    "contract": ["contract", "agreement", "terms and conditions", "party", "effective date", "termination"],
    "form": ["form", "application", "registration", "field", "signature", "date of birth"],
    "report": ["report", "analysis", "findings", "executive summary", "conclusion", "recommendations"],
    "correspondence": ["dear", "sincerely", "regards", "letter", "memo", "email"],
    "legal": ["legal", "court", "lawsuit", "attorney", "plaintiff", "defendant"],
    "financial": ["financial statement", "balance sheet", "income", "expenses", "profit", "loss"],
    "medical": ["patient", "diagnosis", "treatment", "prescription", "medical", "health"],
    "technical": ["specification", "manual", "technical", "requirements", "system", "architecture"],
}

# Keywords per category; the first category with a hit is taken.
CATEGORY_KEYWORDS = {
    "invoice": ["invoice", "bill", "receipt", "payment"],
    "contract": ["contract", "agreement", "terms", "conditions"],
    "report": ["report", "analysis", "summary", "findings"],
    "form": ["form", "application", "registration", "survey"],
    "correspondence": ["letter", "email", "memo", "notice"],
    "legal": ["legal", "court", "lawsuit", "attorney"],
    "financial": ["financial", "statement", "budget", "accounting"],
    "medical": ["medical", "health", "prescription", "diagnosis"],
    "technical": ["technical", "specification", "manual", "documentation"],
}

# How the validator names a document's type from its fields or its text.
VALIDATION_KEYS = {
    "invoice": ["invoice_number", "invoice_date", "total_amount", "vendor_name"],
    "contract": ["parties", "contract_date", "effective_date", "termination"],
}
VALIDATION_WORDS = {
    "invoice": ["invoice", "bill", "receipt"],
    "contract": ["contract", "agreement"],
    "form": ["form", "application"],
    "report": ["report", "analysis"],
}

# Fields a document of each type must have.
REQUIRED_FIELDS = {
    "invoice": ["vendor_name", "invoice_number", "invoice_date", "total_amount"],
    "contract": ["parties", "contract_date", "effective_date"],
    "form": ["form_fields"],
    "report": ["report_type", "executive_summary"],
    "general": ["summary"],
}

# Analysis types with a branch of their own.
ANALYSIS_BRANCHES = ["invoice", "contract", "form", "report"]

# Extraction kinds and check categories, in order.
EXTRACTION_TYPES = ["text", "table", "structure", "full"]
CHECK_CATEGORIES = ["consistency", "format", "business_rules", "completeness"]
BUSINESS_RULES = ["amount_ranges", "date_ranges", "vendor_validity", "tax_calculations"]

# File kinds and size admitted.
SUPPORTED_FORMATS = ["pdf", "jpg", "png", "jpeg", "tiff", "bmp", "docx"]
MAX_FILE_MB = 50
TEXT_EXTENSIONS = ["txt", "md", "json", "csv"]

# Patterns searched for in text.
EMAIL_IN_TEXT = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b"
AMOUNT_IN_TEXT = r"\$\s*[\d,]+\.\d{2}|\d+(?:,\d{3})*(?:\.\d{2})?"
DOLLARS_IN_TEXT = r"\$\s*[\d,]+\.\d{2}"
DATE_IN_TEXT = r"\d{1,2}[/-]\d{1,2}[/-]\d{2,4}"

# Formats a field value must have, by the part of the field name that selects them.
FIELD_FORMATS = {
    "email": [r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$"],
    "phone": [r"^\d{10,15}$"],
    "date": [
        r"^\d{1,2}[/-]\d{1,2}[/-]\d{2,4}$",
        r"^\d{4}[/-]\d{1,2}[/-]\d{1,2}$",
        r"^\d{1,2}\s+(Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)\s+\d{2,4}$",
    ],
    "amount": [r"^\$?\d+(?:,\d{3})*(?:\.\d{2})?$"],
    "invoice_number": [r"^[A-Z]{2,3}\d{6,10}$", r"^\d{8,12}$", r"^[A-Z]\d{2}[A-Z]\d{4}$"],
    "tax_id": [r"^\d{2}-\d{7}$", r"^\d{9}$"],
}
PHONE_PUNCTUATION = r"[\s\-\(\)\+]"

# Date shapes and the orders tried on each, first valid one taken:
# month-day-year before day-month-year, four-digit years in front as they stand.
DATE_SHAPES = [
    (r"^(\d{1,2})([/-])(\d{1,2})\2((?!0000)\d{4})$", ["$4-$1-$3", "$4-$3-$1"]),
    (r"^((?!0000)\d{4})([/-])(\d{1,2})\2(\d{1,2})$", ["$1-$3-$4"]),
]
SHORT_DATE_SHAPE = r"^(\d{1,2})/(\d{1,2})/(\d{1,2})$"
PIVOT_YEAR = 69  # two-digit years from here on belong to the 1900s

# Limits of the rules.
AMOUNT_TOLERANCE = "0.01"
AMOUNT_MAX = 1000000
FUTURE_DAYS_SOFT = 30
FUTURE_DAYS_MAX = 365
PAST_DAYS_MAX = 3650
VENDOR_LENGTH = (2, 100)
TAX_RATE_MAX = 0.5
VALID_SCORE = 0.7

# Token confidence and pixel gaps of the layout steps.
TOKEN_CONFIDENCE = 0.8
TABLE_GAP = 50
ROW_GAP = 30
TABLE_CONFIDENCE = 0.85

# Sentences.
CHECK_ADVICE = {
    "consistency": "Review data for internal consistency",
    "format": "Correct format issues in extracted data",
    "business_rules": "Verify data against business requirements",
    "completeness": "Complete missing required fields",
    "ocr_consistency": "Verify extraction against original document",
}
QUALITY_ADVICE = {
    "low": "Low confidence detected - consider manual review",
    "invalid": "Validation failed - check extracted data for errors",
    "improve": "Consider improving document quality or resolution",
    "high": "High quality extraction - results are reliable",
}
REVIEW_ADVICE = "Manual review recommended"
REVALIDATE_ADVICE = "Manual validation required"

# What Python's str.split() and str.strip() treat as white space.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# Layout of the exported reports.
MARKDOWN_REPORT = (
    "# Document Processing Results\n\n## Summary\n{summary}\n\n## Document Info\n- **Filename**: {filename}\n"
    "- **Type**: {type}\n- **Confidence**: {confidence}\n\n## Extracted Text\n```\n{text}...\n```"
)
MARKDOWN_CHARS = 500
HTML_REPORT = (
    "<html><body><h1>Document Processing Results</h1><h2>Summary</h2><p>{summary}</p><h2>Document Information</h2>"
    "<ul><li>Filename: {filename}</li><li>Type: {type}</li><li>Confidence: {confidence}</li></ul>"
    "<h2>Extracted Text</h2><pre>{text}...</pre></body></html>"
)
HTML_CHARS = 1000

# Keys asked for in a response, sampling temperature, and how much text a request carries.
REQUEST_KEYS = {
    "general": "document_type, main_topics, key_entities, sentiment, urgency_level, action_items, summary, confidence",
    "invoice": "vendor_name, vendor_address, invoice_number, invoice_date, due_date, total_amount, tax_amount, "
    "items (description, quantity, unit_price, total_price), payment_terms, confidence",
    "contract": "parties (name, role, address), contract_date, effective_date, expiration_date, key_clauses, "
    "obligations, termination_conditions, governing_law, jurisdiction, confidence",
    "form": "form_fields (field_name, field_value, confidence), form_type, total_fields, completed_fields, "
    "missing_fields, confidence",
    "report": "report_type, executive_summary, key_findings, recommendations, data_points, charts_tables, confidence",
    "entities": "people, organizations, locations, dates, amounts, emails, phone_numbers, urls",
}
REQUEST_TEMPERATURE = {
    "general": 0.4, "invoice": 0.3, "contract": 0.3, "form": 0.3, "report": 0.4, "entities": 0.3, "summary": 0.7,
}
ENTITY_CHARS = 2000
BRIEF_KEYS = {
    "general": "document_type, main_topics, key_entities, sentiment, summary, confidence",
    "invoice": "vendor_name, invoice_number, invoice_date, total_amount, items, tax_amount, confidence",
    "contract": "parties, contract_date, effective_date, key_clauses, obligations, confidence",
    "form": "form_fields, form_type, total_fields, completed_fields, confidence",
}
BRIEF_CHARS = {"general": 3000, "invoice": 2000, "contract": 2000, "form": 2000}
MAX_TOKENS = 2000
TOP_P = 0.8
