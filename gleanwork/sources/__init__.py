"""Landing: provider payloads, feeds and pages as tables of articles."""
