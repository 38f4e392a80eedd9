class RuleError(ValueError):
    """A rule table, a condition or a parameter is wrong; the message names field and row."""
