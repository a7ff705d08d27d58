"""The same work on streams: contacts from pages, scans from requests, job state from actions."""
