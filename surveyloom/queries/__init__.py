"""Registered queries: every operator over the driver's tables seen as a survey, with its SQL."""
