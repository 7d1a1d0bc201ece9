"""Operators for building training data: joins, scans, filters, encoders and formatters over document tables."""
