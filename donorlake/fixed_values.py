"""Constants, names and word lists that results depend on."""

# --- Webhook event and status names -> ledger status ---------------------------------------------------------
PAYPAL_EVENT_STATUS = {
    "PAYMENT.SALE.COMPLETED": "Paid",
    "PAYMENT.CAPTURE.COMPLETED": "Paid",
    "PAYMENT.SALE.DENIED": "Failed",
    "PAYMENT.CAPTURE.DENIED": "Failed",
    "PAYMENT.SALE.REFUNDED": "Refunded",
    "PAYMENT.CAPTURE.REFUNDED": "Refunded",
}
STRIPE_STATUS = {"succeeded": "Paid", "failed": "Failed"}

# --- Currencies, regions, limits --------------------------------------------------------------------------------
KNOWN_CURRENCIES = ("GBP", "USD", "AUD", "EUR", "CAD", "NZD")
MAX_AMOUNT = {"AUD": 16000}
DEFAULT_MAX_AMOUNT = 2000
CARD_COUNTRY_GROUP = {"USD": "us", "AUD": "au", "EUR": "eu"}
DEFAULT_COUNTRY_GROUP = "uk"
EDITION = {"GBP": "uk", "USD": "us", "AUD": "au"}
DEFAULT_EDITION = "international"
COUNTRY_GROUP_PATH = {
    "uk": "uk",
    "us": "us",
    "au": "au",
    "ca": "ca",
    "nz": "nz",
    "int": "int",
    "eu": "eu",
}
PRESET_AMOUNTS = {
    "au": {"one-off": (50, 100, 250, 500), "monthly": (5, 10, 25, 50)},
    "default": {"one-off": (25, 50, 100, 250), "monthly": (2, 5, 10, 20)},
}
PRESELECTED_AMOUNT = {"au": 100}
DEFAULT_PRESELECTED_AMOUNT = 50

# --- Campaigns whose contributors get no automatic receipt -------------------------------------------------------
NO_RECEIPT_CAMPAIGNS = (
    "co_uk_ema_cns_a",
    "co_uk_ema_cns_b",
    "co_us_ema_cnsus_a",
    "co_int_email_patronask",
)
CONSENT_ID = "supporter"

# --- Placeholders a charge carries when the country is not known -------------------------------------------------
UNKNOWN_COUNTRY = "unknown-country-code"
UNKNOWN_SUBDIVISION = "unknown-country-subdivision-code"

# --- Experiments ---------------------------------------------------------------------------------------------------
MAX_TEST_ID = 10000
TEST_ID_SECONDS = 604800
LANDING_PATTERN = (
    "(gdnwb_copts(.*_banner)|(.*_thrasher)|(.*_ge2017_interactive_slice.*))|(gdnwb_copts_memco_nugget_election)"
)

# --- Component types that are known by name ------------------------------------------------------------------------
COMPONENT_TYPES = ("AcquisitionsEpic", "AcquisitionsEngagementBanner", "AcquisitionsThrasher")

# --- PayPal error names ----------------------------------------------------------------------------------------------
PAYPAL_ERROR_TYPE = {
    "INVALID_RESOURCE_ID": "NotFound",
    "PAYMENT_ALREADY_DONE": "PaymentAlreadyDone",
    "INSTRUMENT_DECLINED": "InstrumentDeclined",
}
BLANK_ERROR_MESSAGE = "Unknown error message"

# --- Card error messages, by (code, decline code) of a card error -----------------------------------------------
CARD_ERROR_MESSAGES = {
    "incorrect_number": "Sorry, the card number that you have entered is incorrect. Please check and retype.",
    "incorrect_cvc": "Sorry, the security code that you have entered is incorrect. Please check and retype.",
    "invalid_number": "Sorry, the card number that you have entered is incorrect. Please check and retype.",
    "invalid_expiry": "Sorry, the expiry date that you have entered is invalid. Please check and re-enter.",
    "invalid_expiry_month": "Sorry, the expiry date that you have entered is invalid. Please check and re-enter.",
    "invalid_expiry_year": "Sorry, the expiry date that you have entered is invalid. Please check and re-enter.",
    "invalid_cvc": "Sorry, the security code that you have entered is invalid. Please check and retype.",
    "expired_card": "Sorry, this card has expired. Please try again with another card.",
    "processing_error": "Sorry, we weren't able to process your payment this time around. Please try again.",
    "client_validation": "Sorry, we've found some problems with your details. Please check and retype.",
}
DECLINE_MESSAGES = {
    "generic_decline": "We're sorry. Your card has been declined.",
    "card_not_supported": "We're sorry. We can't take payment with this type of card. Please try again using Visa, Mastercard or American Express.",
    "try_again_later": "We can't process your payment right now. Please try again later.",
}
GENERIC_ERROR_MESSAGE = "Sorry, we weren't able to process your payment this time around. Please try again."

# --- Counters ----------------------------------------------------------------------------------------------------------
METRIC_NAMES = (
    "home-page-displayed",
    "payment-authorisation-attempt",
    "payment-authorisation-success",
    "payment-authorisation-failure",
    "payment-attempt",
    "payment-success",
    "payment-success-redirected-to-other-platform",
    "payment-failure",
    "unhandled-payment-failure",
    "payment-hook-attempt",
    "payment-hook-parsed",
    "payment-hook-parse-error",
    "payment-hook-processed",
    "payment-hook-processing-error",
    "contribution-paypal-hook-invalid-request",
    "post-payment-page-displayed",
    "thank-you-page-displayed",
)
UNKNOWN_PROVIDER = "unknown"
NO_PROVIDER = "na"
DEFAULT_PLATFORM = "web"

# --- Checkout steps: 1-3 are counted once per page load ----------------------------------------------------------
CHECKOUT_STEPS = {1: "Amount", 2: "PersonalDetails", 3: "Pay", 4: "ThankYou"}
ONCE_PER_PAGE_STEPS = (1, 2, 3)

# --- Browser analytics ---------------------------------------------------------------------------------------------------
ANALYTICS_PLATFORM = "contributions"
MOBILE_PLATFORMS = ("android", "ios")
