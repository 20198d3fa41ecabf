"""Fixed values. Each must stay as it is for results (and content hashes) to
match the data a user already holds; nothing here is logic."""

# --- domains ---------------------------------------------------------------
RUN_TYPES = ("full", "incremental")
RUN_UPDATABLE = (
    "status", "checkpoint", "products_discovered", "products_processed", "products_new",
    "products_updated", "products_unchanged", "products_unavailable", "errors", "summary",
    "completed_at",
)
RUN_JSON = ("checkpoint", "summary")
ITEM_STATUSES = ("pending", "processing", "new", "updated", "unchanged", "failed", "blocked", "skipped")
RELATION_TYPES = ("compatible", "recommended", "related")
EXPORT_FORMATS = ("json", "csv")

PRESENT_STATUSES = ("new", "updated", "unchanged")
ERROR_STATUSES = ("failed", "blocked")
PROCESSED_STATUSES = ("new", "updated", "unchanged", "failed", "blocked", "skipped")
TERMINAL_STATUSES = ("completed", "completed_with_errors", "failed", "cancelled")
SUCCESS_STATUSES = ("completed", "completed_with_errors")
SKIP_STATUSES = ("completed", "completed_with_errors", "cancelled")
NOT_RESUMABLE_STATUSES = ("completed", "cancelled")

# --- tracked fields (the content hash) -------------------------------------
TRACKED_FIELDS = (
    "title", "description", "brand", "model_number", "sku", "current_price",
    "original_price", "currency", "availability", "category", "subcategory",
    "highlights", "whats_in_the_box", "rating", "review_count", "images",
    "specifications",
)

# --- defaults --------------------------------------------------------------
DEFAULT_TITLE = "Untitled product"
DEFAULT_CURRENCY = "USD"
DEFAULT_SECTION = "General"
DEFAULT_IMAGE_TYPE = "gallery"
DEFAULT_MISSING_THRESHOLD = 2

# --- text patterns ---------------------------------------------------------
PRICE_PATTERN = r"-?[0-9,]+(?:\.[0-9]+)?"
CODE_PATTERN = r"(?i)^[A-Z0-9]{10}$"
CODE_IN_PATH_PATTERN = r"(?i)/(?:dp|gp/product)/(?:product/)?([A-Z0-9]{10})(?:[/?]|$)"
BRAND_AFFIX_PATTERN = r"(?i)^(Visit the |Brand:\s*)| Store$"
REVIEW_DATE_PATTERN = r"on ([A-Z][a-z]+ \d{1,2}, \d{4})$"
REVIEW_DATE_FORMAT = "MMMM d, yyyy"
SIZE_TOKEN_PATTERN = r"(?i)\._[^.]+_\.(jpg|jpeg|png|webp)$"
MORE_DETAILS_LINE = "see more product details"

# --- block-page markers, first hit wins ------------------------------------
BLOCK_MARKERS = (
    "verify you are human",
    "checking your browser",
    "attention required",
    "captcha",
    "access denied",
    "请稍候",
)
BLOCKED_ERROR = "access_blocked"

# --- page style A: shop test pages -----------------------------------------
STYLE_A = "webscraper_demo"
STYLE_A_SOURCE = "webscraper-demo"
STYLE_A_REQUIRED = ".title"
STYLE_A_SELECTORS = {
    "title": "h4.title, .title",
    "description": ".description",
    "price": ".price",
    "rating": "[data-rating], .rating",
    "review_count": ".ratings p, .review-count",
    "breadcrumb": ".breadcrumb li",
    "json_ld": "script[type='application/ld+json']",
    "image": "img.image, img.product-img, .product-gallery img",
    "row": "table tr",
    "cell": "th, td",
    "review": ".review, [itemprop='review']",
    "review_text": ".review-text, [itemprop='reviewBody']",
    "review_author": ".reviewer, [itemprop='author']",
    "review_rating": ".rating, [itemprop='ratingValue']",
    "review_title": ".review-title, [itemprop='name']",
}
STYLE_A_CATEGORY_LINK = ".category-link"
STYLE_A_LISTING_CARD = ".card.thumbnail"
STYLE_A_LISTING_LINK = ".card.thumbnail a.title, .card.thumbnail a"
STYLE_A_NEXT_PAGE = "a[rel='next']"
BREADCRUMB_HOME = "home"

# --- page style B: marketplace pages ---------------------------------------
STYLE_B = "amazon"
STYLE_B_SOURCE = "amazon.com"
STYLE_B_URL_PREFIX = "https://www.amazon.com/dp/"
STYLE_B_DEFAULT_TITLE = "Untitled Amazon product"
STYLE_B_SECTION = "Amazon Product Details"
STYLE_B_VARIANT_NAME = "Amazon option"
STYLE_B_REQUIRED = "#productTitle"
STYLE_B_SELECTORS = {
    "title": "span#productTitle",
    "breadcrumb": "#wayfinding-breadcrumbs_feature_div li a",
    "price": "#corePrice_feature_div .a-price .a-offscreen, "
             "#corePriceDisplay_desktop_feature_div .a-price .a-offscreen, #priceblock_ourprice",
    "original_price": "#corePrice_feature_div .a-text-price .a-offscreen, "
                      "#corePriceDisplay_desktop_feature_div .a-text-price .a-offscreen",
    "availability": "#availability",
    "byline": "#bylineInfo",
    "highlight": "#feature-bullets li span.a-list-item",
    "rating": "#acrPopover",
    "review_count": "#acrCustomerReviewText",
    "description_1": "#productDescription",
    "description_2": "#aplus",
    "description_3": "#bookDescription_feature_div",
    "row_1": "#productOverview_feature_div tr",
    "row_2": "#productDetails_techSpec_section_1 tr",
    "row_3": "#productDetails_detailBullets_sections1 tr",
    "cell": "th, td",
    "main_image": "#landingImage",
    "alt_image": "#altImages img",
    "review": "[data-hook='review']",
    "review_text": "[data-hook='review-body'], [data-hook='reviewText'], "
                   "[data-hook='reviewRichContentContainer']",
    "review_badge": "[data-hook='avp-badge']",
    "review_author": ".a-profile-name",
    "review_date": "[data-hook='review-date']",
    "review_rating": "[data-hook='review-star-rating'], [data-hook='cmps-review-star-rating']",
    "review_title": "[data-hook='review-title'], [data-hook='reviewTitle']",
    "link": "a[href*='/dp/'], a[href*='/gp/product/']",
    "option": "[data-asin]:not([data-asin=''])",
}
STYLE_B_LISTING_CARD = "div[data-component-type='s-search-result']"
STYLE_B_LISTING_ITEM = "div[data-component-type='s-search-result'][data-asin]:not([data-asin=''])"
STYLE_B_CODE_ATTRIBUTE = "data-asin"
UNAVAILABLE_WORD = "unavailable"
SPEC_BRAND = "brand"
SPEC_MODEL = ("model name", "item model number")
SPEC_BOX = "included components"
