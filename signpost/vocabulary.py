"""Controlled vocabularies, lookup tables and phrase lists.

Everything here is data that results depend on literally. Values that name a particular
organisation are templates filled from a parameter.
"""

# -- fixed values: service taxonomy (id, label) ---------------------------------------
TAXONOMY = (
    ("health_care", "Healthcare access"),
    ("mental_health", "Mental health and wellbeing"),
    ("insurance", "Health insurance and coverage"),
    ("immigration_status", "Immigration and legal status"),
    ("housing", "Housing and basic needs"),
    ("academics", "Academic and advising support"),
    ("finances", "Financial aid and affordability"),
    ("work_career", "Work and career support"),
    ("tax", "Tax filing and residency information"),
    ("documents_admin", "Campus documents and administration"),
    ("language_integration", "Language and integration"),
    ("safety_urgent", "Urgent or safety-related help"),
)

# -- fixed values: categories that need limitation wording ----------------------------
HIGH_RISK_CATEGORIES = (
    "health_care",
    "mental_health",
    "insurance",
    "immigration_status",
    "tax",
    "finances",
    "safety_urgent",
)

# -- fixed values: urgency levels that trigger the emergency notice -------------------
EMERGENCY_LEVELS = ("emergency", "immediate danger", "life-threatening")
EMERGENCY_NOTICE = (
    "If this is an emergency or immediate safety concern, call 911 or go to the "
    "nearest emergency department."
)

# -- fixed values: hub sections and the category each stands for ----------------------
SECTION_CATEGORIES = (
    ("Housing", "housing"),
    ("Health and emergency services", "healthcare"),
    ("Learning French", "french_learning"),
    ("Integration services", "integration"),
    ("Employment", "employment"),
    ("Steps to take with the federal government", "essential_documents"),
)

# -- fixed values: guidance hub and the detail pages that may be read in depth --------
GUIDANCE_HUB_URL = "https://www.quebec.ca/en/immigration/settle-and-integrate-in-quebec"
DETAIL_PAGE_CATEGORIES = (
    ("https://www.quebec.ca/en/health/finding-a-resource/info-sante-811", "healthcare"),
    ("https://www.quebec.ca/en/health/finding-a-resource/info-social-811", "healthcare"),
    ("https://www.quebec.ca/en/health/finding-a-resource/primary-care-access-point", "healthcare"),
    ("https://www.quebec.ca/en/health/finding-a-resource/quebec-family-doctor-finder", "healthcare"),
    ("https://www.quebec.ca/en/immigration/refugees-asylum-seekers/asylum-seekers", "healthcare"),
    ("https://www.quebec.ca/en/education/learn-french", "french_learning"),
    ("https://www.quebec.ca/en/immigration/integration-service-for-immigrants", "integration"),
    ("https://www.quebec.ca/en/immigration/settle-and-integrate-in-quebec/first-steps-settling-in", "integration"),
    ("https://www.quebec.ca/en/immigration/settle-and-integrate-in-quebec/objectif-integration", "integration"),
)

# -- fixed values: guidance headings that are page furniture --------------------------
GUIDANCE_SKIP_HEADINGS = ("", "On this page:", "See also", "Need help?", "Report a problem")

# -- fixed values: host to agency name ------------------------------------------------
AGENCIES = (
    ("quebec.ca", "Gouvernement du Québec"),
    ("ramq.gouv.qc.ca", "Régie de l'assurance maladie du Québec"),
    ("sante.gouv.qc.ca", "Gouvernement du Québec - Santé"),
    ("tal.gouv.qc.ca", "Tribunal administratif du logement"),
    ("canada.ca", "Government of Canada"),
    ("statcan.gc.ca", "Statistics Canada"),
    ("www150.statcan.gc.ca", "Statistics Canada"),
    ("cnesst.gouv.qc.ca", "CNESST"),
)

# -- fixed values: navigator titles that are page furniture ---------------------------
NAVIGATOR_SKIP_TITLES = (
    "",
    "On this page",
    "Related links",
    "Related services",
    "See also",
    "Contact us",
    "Need help?",
    "Report a problem",
    "Main navigation",
    "Contact",
    "Contact Us",
    "Current",
    "Department and University Information",
    "Home",
    "Alumni & Former Students",
    "Applicants",
    "Office of International Student Services",
)
ORGANISATION_SKIP_TITLE = "Make a gift to {organisation}"

# -- fixed values: text that marks a paragraph as boilerplate -------------------------
BOILERPLATE_FRAGMENTS = ("quick links", "main navigation", "copyright", "accessibility")
ORGANISATION_FRAGMENT = "{organisation} university"

# -- fixed values: link labels that describe an access route --------------------------
ACCESS_KEYWORDS = (
    "contact", "book", "appointment", "apply", "register", "advisor", "adviser", "get support",
)

# -- fixed values: facility source, geography codes and counts ------------------------
FACILITY_SOURCE_URL = "https://www150.statcan.gc.ca/n1/en/pub/13-26-0001/2020001/ODHF_v1.1.zip"
CITY_GEOGRAPHY_CODE = "2466023.0"
PROVINCE_CODE = "qc"

# -- fixed values: partner listing ----------------------------------------------------
PARTNER_SITE_URL = "https://www.quebec.ca"
PARTNER_LIST_PAGES = 17

# -- fixed values: note put on sampled records ----------------------------------------
SAMPLE_REVIEW_STATUS = "structure_verified"
SAMPLE_SAFETY_NOTE = (
    "The official source page, service title, category, and source link were "
    "verified for proposal evidence; eligibility and advice content remain pending human review."
)

# -- fixed values: directory targets (measure, minimum) -------------------------------
DIRECTORY_TARGETS = (
    ("records", 40),
    ("categories", 8),
    ("own_records", 20),
    ("health_records", 10),
)

# -- fixed values: authority order, strongest first -----------------------------------
AUTHORITY_ORDER = (
    ("emergency", 1),
    ("official_university", 2),
    ("official_provincial", 3),
    ("official_federal", 3),
    ("official_municipal", 3),
    ("community", 4),
    ("general", 5),
)

# -- fixed values: cell texts the curated-directory reader treats as missing ----------
MISSING_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)


def skip_titles(organisation: str = "") -> list[str]:
    """Navigator titles to skip, with the organisation's own gift link when it is named."""
    own = [ORGANISATION_SKIP_TITLE.format(organisation=organisation)] if organisation else []
    return [*NAVIGATOR_SKIP_TITLES, *own]


def boilerplate_fragments(organisation: str = "") -> list[str]:
    """Folded fragments that disqualify a paragraph."""
    own = [ORGANISATION_FRAGMENT.format(organisation=organisation.lower())] if organisation else []
    return [*own, *BOILERPLATE_FRAGMENTS]
