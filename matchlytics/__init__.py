"""DataFrame operators for sports-broadcast signal and tracking analytics."""
