"""What shapes the physical plan: null-safe keys, checked broadcasts, durable steps."""
